"""Column builders over item bodies: tokens, sensitivity markers and shapes, storage charge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Substrings of the lower-cased body that mark a category.
CREDENTIAL = ["password:", "passwd:", "api key", "api_key", "apikey", "secret_access_key", "secret key", "private key", "-----begin", "bearer ", "authorization:"]
HEALTH = ["patient", "diagnos", "prescri", "symptom", "medication", "mg daily", "blood pressure", "hypertension", "diabetes", "oncolog", "psychiatr", "therapy session"]
FINANCIAL = ["account number", "routing number", "iban", "credit card", "salary", "net worth"]
LEGAL = ["attorney-client", "privileged and confidential", "settlement agreement", "under seal"]
# Levels by ordinal.
LEVELS = ["public", "internal", "personal", "sensitive", "restricted"]

SECRET_LENGTH, PHONE_DIGITS = 20, 10


def raw_tokens(body: Column) -> Column:
    """Parts between runs of Unicode white space."""
    return F.filter(F.split(body, r"(?U)\s+"), lambda x: x != "")


def tokens(body: Column) -> Column:
    return raw_tokens(F.lower(body))


def token_set(body: Column) -> Column:
    return F.array_distinct(tokens(body))


def contains_any(lowered: Column, markers: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [lowered.contains(m) for m in markers])


def secret_token(body: Column) -> Column:
    """Some token, trimmed to letters and digits at its ends, is long, plain, and has a letter and a digit.

    A plain search comes first, so that few bodies are split.
    """
    core = lambda t: F.regexp_replace(t, r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")
    shaped = lambda t: core(t).rlike(r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_-]{%d,}$" % SECRET_LENGTH)
    return body.rlike(r"[A-Za-z0-9_-]{%d}" % SECRET_LENGTH) & F.exists(raw_tokens(body), shaped)


def email(body: Column) -> Column:
    def shaped(t):
        at = F.instr(t, "@")
        return (at > 1) & F.substring(t, at + 1, F.length(t)).contains(".") & ~t.endswith(".")

    return body.contains("@") & F.exists(raw_tokens(body), shaped)


def phone(body: Column) -> Column:
    return (F.regexp_count(body, F.lit("[0-9]")) >= PHONE_DIGITS) & body.rlike(r"[-()+]")


def sensitivity(body: Column, low: Column | None = None) -> dict[str, Column]:
    """The five categories in their fixed order; ``low`` is a column that holds the lower-cased body already."""
    low = F.lower(body) if low is None else low
    return {
        "credential": contains_any(low, CREDENTIAL) | secret_token(body), "health": contains_any(low, HEALTH), "financial": contains_any(low, FINANCIAL),
        "legal": contains_any(low, LEGAL), "pii": email(body) | phone(body),
    }


def with_sensitivity(items: DataFrame) -> DataFrame:
    """``items`` with the categories and ``sensitivity``. The body is lower-cased once, in a projection of its own."""
    lowered = items.withColumn("_low", F.lower("body"))
    return lowered.withColumns(sensitivity(F.col("body"), F.col("_low"))).drop("_low").withColumn("sensitivity", level())


def level() -> Column:
    """Ordinal of the detected level, from the category columns; never below internal."""
    return F.when(F.col("credential"), 4).when(F.col("health") | F.col("financial") | F.col("legal"), 3).when(F.col("pii"), 2).otherwise(1)


def confidence() -> Column:
    return F.when(F.col("credential"), 0.9).when(F.col("health") | F.col("financial") | F.col("legal"), 0.7).when(F.col("pii"), 0.6).otherwise(0.5)


def raised(detected: Column, hint: Column) -> Column:
    """A hint raises a level and never lowers it."""
    return F.greatest(detected, F.coalesce(hint, detected))


def estimated_tokens(body: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.octet_length(body) / 4)).cast("long")


def markdown_escaped(body: Column) -> Column:
    return F.regexp_replace(body, r"(?m)^(\s*)#", r"$1\\#")


def slug(name: Column) -> Column:
    """A directory name: lower case, other runs become one hyphen, 240 bytes, ``default`` if nothing is left."""
    out = F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9._-]+", "-"), "^[-.]+|-+$", ""), 1, 240)
    return F.when(out == "", "default").otherwise(out)


def valid_component(name: Column) -> Column:
    return name.rlike("^[a-z0-9_-][a-z0-9._-]*$") & (F.octet_length(name) <= 240)


def valid_body(body: Column) -> Column:
    return body.rlike(r"(?U)\S") & (F.octet_length(body) <= 65_536)
