"""A template language over columns: named fields with format specs, doubled braces, and one result for every error.

A template is cut into tokens by one pattern; higher-order functions over the array of tokens read each field, lay it out and
join the pieces. Templates are data, one a row, and nothing needs a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a token is (a doubled brace, a field with at most one level of fields in its spec, other text, a stray
#: brace), the parts of a field, the parts of a spec, the digits of a group by presentation.
TOKEN = r"\{\{|\}\}|\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}|[^{}]+|[{}]"
FIELD = r"(?s)^([A-Za-z_0-9]+)(?:\[(\d{1,9})\])?(?:!([sra]))?(?::(.*))?$"
SPEC = r"(?s)^(?:([^{}])?([<>=^]))?([-+ ])?(#)?(0)?0*(\d{1,4})?([,_])?(?:\.0*(\d{1,9}))?([sdnboxX])?$"
GROUP_OF = {"": 3, "d": 3, "b": 4, "o": 4, "x": 4, "X": 4}


def format_fields(template: Column, values: dict[str, Column], numbers: tuple[str, ...] = ()) -> Column:
    """The template with its fields filled from values; null where the template is null or has any error.

    values: a column for each name; those in numbers are integers, all others strings. A field is `{name}`, `{name[3]}` (a
    character of a string), `{name!s}` and `{name:spec}`; a spec is `[[fill]align][sign][#][0][width][,_][.precision][type]`
    with the types s for strings and d, n, b, o, x, X for integers, and may have plain fields in it. Errors are stray braces,
    unknown names, null values of fields that are used, and specs that don't fit their value. Errors too, for what isn't
    offered, are attributes, `!r` and `!a` of strings, integers laid out as characters or floats, and widths over 9999.
    """
    texts = F.create_map(*[x for name, v in values.items() for x in (F.lit(name), v.cast("string"))])
    tokens = F.regexp_extract_all(template, F.lit(TOKEN), F.lit(0))
    for step in (_split, lambda t: _read(t, texts, values, numbers), _parts, _specified, _laid_out, _padded):  # each names what the next uses more than once
        tokens = F.transform(tokens, step)
    pieces = tokens
    return F.when(~F.exists(pieces, lambda p: p.isNull()), F.array_join(pieces, ""))


def _split(token: Column) -> Column:
    """A token with the parts of its field, if it is one."""
    inner = F.substring(token, F.lit(2), F.length(token) - 2)
    field = token.startswith("{") & (F.length(token) > 1) & (token != "{{")
    parts = [F.when(field, F.regexp_extract(inner, FIELD, i)).otherwise("").alias(n) for i, n in enumerate(("name", "index", "conversion", "spec"), 1)]
    return F.struct(token.alias("token"), field.alias("field"), *parts)


def _read(t: Column, texts: Column, values: dict[str, Column], numbers: tuple[str, ...]) -> Column:
    """A token as its literal text, or as a field's value and spec; both are null in an error."""
    token, field, name, index, conversion, spec = (t[n] for n in ("token", "field", "name", "index", "conversion", "spec"))
    whole = F.try_element_at(texts, name)
    number = name.isin(*numbers) if numbers else F.lit(False)
    at = index.try_cast("int")
    indexed = F.when(~number & (at < F.length(whole)), F.substring(whole, at + 1, F.lit(1)))
    value = F.when(index != "", indexed).otherwise(whole)
    value = F.when(conversion.isin("r", "a") & ~number, None).otherwise(value)
    filled = spec
    for k, v in values.items():
        filled = F.replace(filled, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("{")))
    filled = F.when(spec.contains("{"), filled).otherwise(spec)
    literal = F.when(token == "{{", "{").when(token == "}}", "}").when(~token.rlike("[{}]"), token)
    return F.struct(
        F.when(~field, literal).alias("literal"), F.when(field, value).alias("value"), F.when(field, filled).alias("spec"),
        (number & (conversion == "")).alias("number"),
    )


def _parts(t: Column) -> Column:
    """The token with the parts of its spec, and whether the spec has the form of one."""
    names = ("fill", "align", "sign", "alternate", "zero", "width", "group", "precision", "kind")
    plain = F.coalesce(t["spec"] == "", F.lit(True))
    parts = [F.when(plain, "").otherwise(F.regexp_extract(t["spec"], SPEC, i)).alias(n) for i, n in enumerate(names, 1)]
    return F.struct(t["literal"].alias("literal"), t["value"].alias("value"), t["number"].alias("number"), (plain | t["spec"].rlike(SPEC)).alias("formed"), *parts)


def _specified(t: Column) -> Column:
    """The parts of a field's spec; ok where it has a value, and a spec that fits this."""
    fill, align, sign, alternate, zero, width, group, precision, kind = (t[n] for n in ("fill", "align", "sign", "alternate", "zero", "width", "group", "precision", "kind"))
    fits = F.when(t["number"], (precision == "") & (kind != "s") & ~((group == ",") & ~kind.isin("", "d")) & ~((group == "_") & (kind == "n")))
    fits = fits.otherwise(kind.isin("", "s") & (sign == "") & (alternate == "") & (group == "") & (align != "="))
    right, left = F.when(zero == "0", "=").otherwise(">"), F.lit("<")
    return F.struct(
        t["literal"].alias("literal"), t["value"].alias("value"), t["number"].alias("number"),
        F.when(fill != "", fill).when(zero == "0", "0").otherwise(" ").alias("fill"),
        F.when(align != "", align).when(t["number"], right).otherwise(left).alias("align"),
        sign.alias("sign"), (alternate == "#").alias("alternate"), F.coalesce(width.try_cast("int"), F.lit(0)).alias("width"), group.alias("group"),
        F.coalesce(precision.try_cast("int"), F.lit(2**31 - 1)).alias("precision"), kind.alias("kind"),
        (t["value"].isNotNull() & t["formed"] & fits).alias("ok"),
    )


def _laid_out(t: Column) -> Column:
    """What stands before the padding of `=` (sign and prefix), and the digits or the text behind it."""
    n = t["value"].try_cast("long")
    size = F.abs(n)
    digits = F.when(t["kind"] == "b", F.bin(size)).when(t["kind"] == "o", F.conv(size.cast("string"), 10, 8)).when(t["kind"] == "x", F.lower(F.hex(size))).when(t["kind"] == "X", F.hex(size)).otherwise(size.cast("string"))
    sign = F.when(n < 0, "-").when(t["sign"].isin("+", " "), t["sign"]).otherwise("")
    prefix = F.when(t["alternate"] & t["kind"].isin("b", "o", "x", "X"), F.concat(F.lit("0"), t["kind"])).otherwise("")
    head = F.concat(sign, prefix)
    each = F.lit(None).cast("int")
    for kind, of in GROUP_OF.items():
        each = F.when(t["kind"] == kind, of).otherwise(each)
    # zeros that fill up a grouped number are grouped as well, and a separator never comes first
    room = F.greatest(t["width"] - F.length(head), F.lit(1))
    least = F.when((t["fill"] == "0") & (t["align"] == "="), room - F.floor((room - 1) / (each + 1)).cast("int")).otherwise(1)
    full = F.concat(F.repeat(F.lit("0"), F.greatest(least - F.length(digits), F.lit(0))), digits)
    by = lambda k: F.reverse(F.regexp_replace(F.reverse(full), F.lit(f"(.{{{k}}})(?=.)"), F.concat(F.lit("$1"), t["group"])))
    digits = F.when(t["group"] == "", digits).when(each == 3, by(3)).otherwise(by(4))
    return F.struct(
        t["literal"].alias("literal"), t["ok"].alias("ok"), t["fill"].alias("fill"), t["align"].alias("align"), t["width"].alias("width"),
        F.when(t["number"], head).otherwise("").alias("head"), F.when(t["number"], digits).otherwise(F.substring(t["value"], F.lit(1), t["precision"])).alias("body"),
    )


def _padded(t: Column) -> Column:
    """The text of a token; null in an error."""
    missing = F.greatest(t["width"] - F.length(t["head"]) - F.length(t["body"]), F.lit(0))
    half = F.floor(missing / 2).cast("int")
    pad = lambda n: F.repeat(t["fill"], n)
    text = (
        F.when(t["align"] == "<", F.concat(t["head"], t["body"], pad(missing))).when(t["align"] == ">", F.concat(pad(missing), t["head"], t["body"]))
        .when(t["align"] == "^", F.concat(pad(half), t["head"], t["body"], pad(missing - half))).otherwise(F.concat(t["head"], pad(missing), t["body"]))
    )
    return F.when(t["literal"].isNotNull(), t["literal"]).when(t["ok"], text)
