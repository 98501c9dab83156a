"""Text-line parsing rules (B1-B8) as Column expressions.

Every parser returns a struct with the parsed fields and a ``reject`` reason
(NULL when the line is good).  Nothing raises on bad input: the reference throws
inside a task, here the row is routed to a reject table instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reject reasons a parser can emit.
REJECT_SHORT = "short_line"
REJECT_LABEL = "bad_label"
REJECT_FEATURE = "bad_feature"
REJECT_ARITY = "arity"
REJECT_TOO_MANY = "too_many_fields"
REJECT_FORMAT = "bad_format"
REJECT_FIELD = "bad_field"
REJECT_FRAGMENT = "fragment"

_INT_TEXT = r"^[+-]?[0-9]+$"
_TUPLE_POINT = r"^\(([^,]+),\[(.*)\]\)$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_once(df, parser: Column, *keep) -> "DataFrame":
    """Evaluate a parser struct once per row and expose its fields as columns.

    Without a barrier, a later ``filter(reject IS NULL)`` is pushed through every
    projection (down into a join condition, if there is one) with the whole parse
    inlined, and evaluated again for the output.  ``explode`` of a one-element
    array is a Generate node; filters on its output stay above it, so the parse
    runs once, in the projection below.
    """
    return df.select(*keep, F.explode(F.array(parser)).alias("_p")).select(*keep, "_p.*")


# Every character <= U+0020 (what Java's String.trim removes).
_CONTROL_CHARS = "".join(chr(c) for c in range(0x21))


def trim_controls(value) -> Column:
    """Strip control characters and blanks (<= U+0020) at both ends.

    ``btrim`` with the explicit character set is a plain JVM string scan
    (no regex); ``F.trim`` alone would leave NUL padding in place."""
    return F.btrim(_col(value), F.lit(_CONTROL_CHARS))


def _java_split(value, sep: str) -> Column:
    # Java's split drops trailing empty fields; Spark's keeps them.  The regex only
    # runs on the rare line that ends with the separator.
    v = _col(value)
    return F.split(F.when(v.endswith(sep), F.regexp_replace(v, f"(?:{sep})+$", ""))
                   .otherwise(v), sep)


def _try_double(s: Column) -> Column:
    return s.try_cast("double")


def label_pm1(label_double) -> Column:
    """Truncate the label to a JVM int (saturating; NaN -> 0), then even -> -1.0, odd -> +1.0.

    The JVM remainder keeps the sign, so -1 is odd and maps to +1.
    """
    d = _col(label_double)
    as_int = (F.when(F.isnan(d), F.lit(0).cast("long"))
              .when(d >= 2147483647.0, F.lit(2147483647).cast("long"))
              .when(d <= -2147483648.0, F.lit(-2147483648).cast("long"))
              .otherwise(d.try_cast("long")))
    return F.when(as_int % 2 == 0, F.lit(-1.0)).otherwise(F.lit(1.0))


def with_bias(x) -> Column:
    """Append the constant 1.0 as the last feature."""
    return F.concat(_col(x), F.array(F.lit(1.0)))


def parse_point_fields(line, d: int, mode: str = "stream",
                       min_length: int | None = None) -> Column:
    """Parse ``label,f1,...`` into struct(y, x, reject).

    ``mode="stream"`` follows the socket path (B7): fewer than d features keep 0.0
    in the missing slots, exactly d+1 drops the extra value into the (then
    overwritten) bias slot, more than d+1 is rejected.  ``mode="file"`` follows the
    bounded loader: exactly d features, anything else is rejected (Q7).
    ``min_length`` enables the reference's length guard (B2, ``10 + d`` there).
    """
    line = _col(line)
    fields = _java_split(line, ",")
    n_feat = F.size(fields) - 1
    label = _try_double(F.try_element_at(fields, F.lit(1)))
    # every present feature field must parse, including a (d+1)-th that is dropped
    rest = F.slice(fields, F.lit(2), F.greatest(F.size(fields) - F.lit(1), F.lit(0)))
    bad_feature = F.exists(rest, lambda s: _try_double(s).isNull())
    feats = F.transform(F.sequence(F.lit(2), F.lit(d + 1)),
                        lambda i: F.coalesce(_try_double(F.try_element_at(fields, i)),
                                             F.lit(0.0)))
    if mode == "stream":
        arity_bad, arity_reason = n_feat > d + 1, REJECT_TOO_MANY
    elif mode == "file":
        arity_bad, arity_reason = n_feat != d, REJECT_ARITY
    else:
        raise ValueError(f"unknown mode {mode!r}")
    reject = F.when(line.isNull(), F.lit(REJECT_FORMAT))
    if min_length is not None:
        reject = reject.when(F.length(line) < min_length, F.lit(REJECT_SHORT))
    reject = (reject.when(label.isNull(), F.lit(REJECT_LABEL))
              .when(arity_bad, F.lit(arity_reason))
              .when(bad_feature, F.lit(REJECT_FEATURE)))
    return F.struct(label_pm1(label).alias("y"), with_bias(feats).alias("x"),
                    reject.alias("reject"))


def parse_tuple_point(line, num_features: int | None = None) -> Column:
    """Parse ``(y,[x1,...,xn])`` (or the legacy ``y,x1 x2 ...``) into struct(y, x, reject).

    No bias is added; the label is taken as is (real-valued).
    """
    line = F.trim(_col(line))
    is_tuple = line.rlike(_TUPLE_POINT)
    y_txt = F.when(is_tuple, F.regexp_extract(line, _TUPLE_POINT, 1)) \
        .otherwise(F.substring_index(line, ",", 1))
    x_txt = F.when(is_tuple, F.regexp_extract(line, _TUPLE_POINT, 2)) \
        .otherwise(F.trim(F.regexp_extract(line, r"^[^,]*,(.*)$", 1)))
    parts = F.when(is_tuple, F.split(x_txt, ",")).otherwise(F.split(x_txt, " +"))
    x = F.transform(parts, lambda s: _try_double(F.trim(s)))
    y = _try_double(F.trim(y_txt))
    reject = (F.when(line.isNull() | (~is_tuple & ~line.contains(",")), F.lit(REJECT_FORMAT))
              .when(y.isNull(), F.lit(REJECT_LABEL))
              .when(F.exists(x, lambda v: v.isNull()), F.lit(REJECT_FEATURE)))
    if num_features is not None:
        reject = reject.when(F.size(x) != num_features, F.lit(REJECT_ARITY))
    return F.struct(y.alias("y"), x.alias("x"), reject.alias("reject"))


def _rating_cuts(line: Column, sep: str) -> tuple[Column, Column, Column, Column]:
    # Java's split drops trailing empty fields; the regex only runs on the rare
    # line that ends with the separator.  split_part / replace are literal.
    body = F.when(line.endswith(sep), F.regexp_replace(line, f"(?:{_quote(sep)})+$", "")) \
        .otherwise(line)
    lit_sep = F.lit(sep)
    n_fields = F.when(F.length(body) == 0, F.lit(1)).otherwise(
        (F.length(body) - F.length(F.replace(body, lit_sep, F.lit("")))) / F.lit(len(sep))
        + F.lit(1)).cast("int")
    f0, f1, f2 = (F.split_part(body, lit_sep, F.lit(i)) for i in (1, 2, 3))
    return f0, f1, f2, n_fields


def _rating_struct(line: Column, f0: Column, f1: Column, f2: Column, n_fields: Column,
                   min_length: int | None) -> Column:
    user = F.when(f0.rlike(_INT_TEXT), f0.try_cast("int"))
    item = F.when(f1.rlike(_INT_TEXT), f1.try_cast("int"))
    rating = _try_double(f2)
    reject = F.when(line.isNull(), F.lit(REJECT_FORMAT))
    if min_length is not None:
        reject = reject.when(F.length(line) < min_length, F.lit(REJECT_FRAGMENT))
    reject = (reject.when(n_fields < 3, F.lit(REJECT_ARITY))
              .when(user.isNull() | item.isNull() | rating.isNull(), F.lit(REJECT_FIELD)))
    return F.struct(user.alias("user"), item.alias("item"), rating.alias("rating"),
                    reject.alias("reject"))


def parse_rating_fields(line, sep: str = "::", min_length: int | None = None) -> Column:
    """Parse ``user::item::rating[::...]`` into struct(user, item, rating, reject).

    Extra fields are ignored; user and item must be JVM int text, rating any double.
    ``min_length`` is the reference's guard (5), applied to the given column.
    Single-expression form; for large frames prefer :func:`parse_ratings`.
    """
    line = _col(line)
    return _rating_struct(line, *_rating_cuts(line, sep), min_length)


def parse_ratings(df, line: str = "value", sep: str = "::", min_length: int | None = None,
                  keep=()) -> "DataFrame":
    """A3 / B4 on a frame: columns ``keep + (user, item, rating, reject)``.

    The literal field cuts are projected as columns first and the typed struct is
    built from them behind a Generate barrier (:func:`parse_once`), so neither a
    pushed-down filter nor the output repeats the cuts.
    """
    keep = list(keep)
    cols = list(dict.fromkeys(keep + [line]))
    f0, f1, f2, nf = _rating_cuts(F.col(line), sep)
    typed = df.select(*cols, nf.alias("_nf"),
                      F.when(f0.rlike(_INT_TEXT), f0.try_cast("int")).alias("user"),
                      F.when(f1.rlike(_INT_TEXT), f1.try_cast("int")).alias("item"),
                      _try_double(f2).alias("rating"))
    # the struct behind the barrier only references columns: nothing is evaluated twice
    return parse_once(typed, _rating_reject_struct(F.col(line), min_length), *keep)


def _rating_reject_struct(line: Column, min_length: int | None) -> Column:
    user, item, rating = F.col("user"), F.col("item"), F.col("rating")
    reject = F.when(line.isNull(), F.lit(REJECT_FORMAT))
    if min_length is not None:
        reject = reject.when(F.length(line) < min_length, F.lit(REJECT_FRAGMENT))
    reject = (reject.when(F.col("_nf") < 3, F.lit(REJECT_ARITY))
              .when(user.isNull() | item.isNull() | rating.isNull(), F.lit(REJECT_FIELD)))
    return F.struct(user.alias("user"), item.alias("item"), rating.alias("rating"),
                    reject.alias("reject"))


def _quote(sep: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in sep)
