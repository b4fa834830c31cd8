"""Constants of the market model."""

#: Ecto per armbrace where a price is parsed or checked, and where it is displayed.
ARMBRACE_PARSED, ARMBRACE_SHOWN = 27.0, 26.0
#: Platinum per ecto.
PLATINUM = 15.0
STACK = 250.0
#: Hours that an offer stays active, days that a message is kept, messages kept, and inactive offers kept per market and side.
TTL_HOURS, RETENTION_DAYS, MESSAGE_CAP, HISTORY_CAP = 200, 21, 75_000, 250
MAX_PRICE = 1e8

CURRENCIES = ("a", "e", "k")
#: Bases whose unit price is not to be trusted.
UNSURE_BASES = ("bundle", "currency_exchange", "unknown", "currency_conversion", "unqualified", "uncertain", "range")
QUALITY = ("accepted", "review", "rejected")
LIFECYCLE = ("active", "superseded", "expired", "rejected")
PRICE_QUALITY = ("trusted", "uncertain", "outlier", "unpriced")
