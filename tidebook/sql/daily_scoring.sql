-- Closing deals of the day before the scoring date; view: deals; parameter: scoring_date.
SELECT to_timestamp_ntz(:scoring_date) AS fact_timest,
       user_uid,
       count(*) AS cnt_deals
FROM deals
WHERE entry = 1
  AND lower(server_name) LIKE '%real%'
  AND date >= date_sub(CAST(:scoring_date AS DATE), 1)
  AND date < CAST(:scoring_date AS DATE)
GROUP BY user_uid;
