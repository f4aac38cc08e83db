"""Column functions on text: all are built-in expressions, so they stay in generated code and reach the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token class, and the wording that a question is refused for.
TOKEN = "[a-zA-Zа-яА-ЯёЁ0-9_/+.-]+"
SECRET = r"парол|password|passwd|secret|секрет|credential|api[\s_-]?key|токен|token|зарплат|salary|compensation|ssn|паспорт"
OUT_OF_SCOPE = r"отпуск|vacation|больничн|когда\s+\w+\s+выйд|личный|личн(ая|ое|ые)\s+(жизнь|телефон|адрес)"


def tokens(text: Column) -> Column:
    """Lower-case tokens in order, repeats included; null has none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def or_else(text: Column, *others: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (text, *others)])


def clip(text: Column, limit: int) -> Column:
    """At most `limit` characters and an ellipsis; no limit at 0 or below."""
    return F.when(F.lit(limit <= 0) | (F.length(text) <= limit), text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, limit), r"(?U)\s+$", ""), F.lit("…")))


def quote(text: Column, limit: int) -> Column:
    """White space folded, then clipped."""
    return clip(strip(F.regexp_replace(text, r"(?U)\s+", " ")), limit)


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def refuse_reason(question: Column) -> Column:
    """empty_query, secret, out_of_scope, or null: the first that holds. Matches lie anywhere in the words."""
    q = strip(F.coalesce(question, F.lit("")))
    return F.when(q == "", "empty_query").when(q.rlike(f"(?iuU){SECRET}"), "secret").when(q.rlike(f"(?iuU){OUT_OF_SCOPE}"), "out_of_scope")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """Unit length; the norm counts as 1e-12 at least."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / norm)


def request_id(header: Column) -> Column:
    """A request's own id, at most 128 characters of it, or a new one."""
    return F.coalesce(F.substring(F.nullif(F.trim(header), F.lit("")), 1, 128), F.uuid())
