-- Users and mean operation amounts by country; views: users, balance.
WITH first_registration AS (
    SELECT user_id, min_by(country_code, registration_time) AS country_code
    FROM users
    GROUP BY user_id
),
per_user AS (
    SELECT user_id,
           sum(CASE WHEN operation_type = 'deposit' THEN operation_amount_usd END) AS deposit,
           count(CASE WHEN operation_type = 'deposit' THEN 1 END) AS deposits
    FROM balance
    GROUP BY user_id
)
SELECT country_code,
       count(*) AS cnt_users,
       count(per_user.user_id) AS cnt_users_with_money,
       round(try_divide(CAST(sum(deposit) AS DOUBLE), sum(deposits)), 4) AS avg_deposit
FROM first_registration
LEFT JOIN per_user ON per_user.user_id = first_registration.user_id
GROUP BY country_code
ORDER BY cnt_users DESC NULLS LAST, country_code;
