"""Column expressions over offers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ARMBRACE_PARSED, CURRENCIES, PLATINUM, UNSURE_BASES

c = F.col


def once(x: Column, f) -> Column:
    """``f(x)``, evaluated once however many of its fields are used."""
    return F.transform(F.array(x), f)[0]


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def market() -> Column:
    """The key that most operators group by."""
    return F.coalesce(blank_to_null(c("normalized_market_key")), c("market_key"))


def intelligence_market() -> Column:
    """As :func:`market`, falling back to the item where both keys are blank."""
    return F.coalesce(blank_to_null(c("normalized_market_key")), blank_to_null(c("market_key")), blank_to_null(c("item_key")))


def mover_market() -> Column:
    """As :func:`market`, falling back to the item where both keys are null (a blank key stays)."""
    return F.coalesce(blank_to_null(c("normalized_market_key")), c("market_key"), c("item_key"))


def key(x: Column, separator: str = "_") -> Column:
    """Lower case, runs of anything but letters and digits turned into one separator, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", separator), F.lit(separator))


def variant() -> Column:
    """A label of requirement, attribute and flags; 'Standaard' if there is none."""
    parts = F.concat_ws(
        " ", F.when(c("requirement").isNotNull(), F.concat(F.lit("q"), c("requirement").cast("string"))), blank_to_null(c("attribute_key")),
        F.when(c("is_oldschool"), F.lit("OS")), F.when(c("is_inscribable"), F.lit("inscribable")),
    )
    return F.when(parts == "", "Standaard").otherwise(parts)


def identity() -> Column:
    """The variant that a trader can list once per side: the normalised key if it is this item's, else five parts."""
    own = F.split_part(c("normalized_market_key"), F.lit("|"), F.lit(1)) == c("item_key")
    parts = F.concat_ws(
        "|", c("item_key"), F.coalesce(c("requirement").cast("string"), F.lit("")), F.coalesce(c("attribute_key"), F.lit("")),
        c("is_oldschool").cast("int").cast("string"), c("is_inscribable").cast("int").cast("string"),
    )
    return F.when(own, c("normalized_market_key")).otherwise(parts)


def market_identity(item_key: Column, requirement: Column, attribute: Column, oldschool: Column, inscribable: Column, relevant: Column) -> Column:
    """item|q:9|attribute:a|oldschool:1|inscribable:1 and then the relevant fields by name."""
    flag = lambda x, name: F.when(x, F.lit(f"{name}:1"))
    rest = F.transform(F.array_sort(F.map_entries(relevant)), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return F.concat_ws(
        "|", item_key, F.when(requirement.isNotNull(), F.concat(F.lit("q:"), requirement.cast("string"))),
        F.when(blank_to_null(attribute).isNotNull(), F.concat(F.lit("attribute:"), key(attribute))), flag(oldschool, "oldschool"), flag(inscribable, "inscribable"), rest,
    )


def to_ecto(amount: Column, currency: Column) -> Column:
    low = F.lower(F.trim(currency))
    return F.when(low == "a", amount * ARMBRACE_PARSED).when(low == "e", amount).when(low.isin("k", "plat", "platinum"), amount / PLATINUM)


def trusted_price() -> Column:
    """Whether the unit price can be relied on."""
    guard = (c("item_key") != "armbrace_of_truth") | ((c("price_currency") == "e") & (c("price_amount") > 0) & (c("price_amount") <= 100))
    return F.coalesce(
        c("price_currency").isin(*CURRENCIES) & (c("unit_price") > 0) & ~F.coalesce(c("price_basis"), F.lit("unknown")).isin(*UNSURE_BASES)
        & (F.coalesce(c("price_quality_status"), F.lit("trusted")) == "trusted") & guard,
        F.lit(False),
    )


def shown_price() -> Column:
    return F.when(trusted_price(), c("unit_price"))


def money_per_item() -> Column:
    """The amount paid for one item, from amount, quantity and basis."""
    many = c("price_basis").isin("total", "ratio", "exchange", "stack", "stack_total", "set") & (c("quantity") > 0)
    return F.when(many, c("price_amount") / c("quantity")).otherwise(c("price_amount"))


def deal(price: Column, median: Column, side: Column) -> Column:
    """A label by the ratio of a price to its side's median at 5 and 15 percent; cheap is good for a sale, dear for a purchase."""
    ratio = F.when(side == "sell", price / median).otherwise(median / price)
    usable = (price > 0) & (median > 0)
    return F.when(~usable | price.isNull() | median.isNull(), "unknown").when(ratio <= 0.85, "great").when(ratio <= 0.95, "good").when(ratio < 1.05, "fair").when(ratio < 1.15, "poor").otherwise("bad")


def price_text(ecto: Column, armbrace: float = 26.0) -> Column:
    """'12,5e', or armbraces from 500 ecto on; decimal comma, no trailing zeros."""
    value, unit = F.when(ecto >= 500, ecto / armbrace).otherwise(ecto), F.when(ecto >= 500, "a").otherwise("e")
    plain = F.regexp_replace(F.regexp_replace(F.replace(F.format_number(F.round(value, 2), 2), F.lit(","), F.lit("")), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.concat(F.replace(plain, F.lit("."), F.lit(",")), unit)


def relative_time(at: Column, now: Column) -> Column:
    s = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(at.cast("timestamp"))
    n = lambda d, u: F.concat(F.floor(s / d).cast("string"), F.lit(u))
    return F.when(s < 60, "nu").when(s < 3600, n(60, " min")).when(s < 86400, n(3600, " uur")).otherwise(n(86400, " d"))


def matches(query: str, *columns: str) -> Column:
    """Whether any of the columns holds ``query``, without regard to case."""
    found = F.lit(False)
    for name in columns:
        found = found | F.coalesce(F.contains(F.lower(c(name)), F.lit(query.lower())), F.lit(False))
    return found


def clamp_limit(limit: int, most: int) -> int:
    return max(1, min(most, limit))
