"""Fixed values of the business rules. They must stay as they are for equal results."""

# Index instruments whose exposure is followed.
EXPOSURE_SYMBOLS = ("AUS200", "US30", "FR40", "DE30", "HK50", "JP225", "USTEC", "US500", "STOXX50", "UK100")

# Instruments of the spread report.
SPREAD_SYMBOLS = ("XAUUSD", "EURUSD", "GBPUSD", "USDJPY", "GBPJPY", "BTCUSD", "USOIL", "USDCAD", "GBPAUD", "AUDUSD")

# Instruments of the swap reports.
SWAP_SYMBOLS = (
    "XAUUSD", "GBPUSD", "EURUSD", "USDJPY", "GBPJPY", "BTCUSD", "USOIL", "USDCAD", "USDCHF", "GBPAUD",
    "AUDUSD", "EURJPY", "US30", "EURAUD", "AUDCAD", "USTEC", "EURGBP", "AUDJPY", "GBPNZD", "GBPCAD",
)

# Account-type letters at the end of an instrument name.
SPREAD_SUFFIX_LETTERS = "empkfzc"
QUOTE_SUFFIXES = ("m", "c", "z", "r", "p", "e", "")

# Comments and reject texts.
STOPOUT_MARK = "D-NULL"
STOPOUT_PREFIX = "[so"
HEDGE_CLOSE_PREFIX = "close hedge by"
REJECT_COMMENT = "margin no money (precheck)"

# Liquidity-provider logins, and business accounts kept beside the dimension.
PROVIDER_LOGINS = (46000004, 45002204, 46000006)
BUSINESS_LOGINS = (46000009, 46000010, 46000012, 46000013)

# Hours of a trading session and its days (0 = Sunday).
SESSION_HOURS = (12, 13, 14, 15, 16, 17, 18, 19, 20, 21)
SESSION_DAYS = (0, 1, 2, 3, 4)

# Portfolio costs - commission share, monthly depository fee, dividend left after tax.
COMMISSION = 0.001
DEPOSITORY_FEE = 150
DIVIDEND_AFTER_TAX = 0.87

# Tax systems as written in the company files.
TAX_LABELS = {"osno": "ОСНО", "envd": "ЕНВД", "usn": "УСН", "expense": "расходов"}
