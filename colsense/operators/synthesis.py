"""Synthetic columns: values by templates and by formats that a code's words suggest, under telling and opaque names.

Every draw is a number made of an MD5 of seed, column, row and slot, so a value follows
from its place alone: columns are the same on each run, whatever tasks make them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import numbered

#: Words of a code's texts, in order, the first that is found counts, and the format of its values.
#: {lo-hi:width} is a number, {a|b} a choice, {A} a letter, {xN} and {0N} N hexadecimal and decimal digits.
FORMATS = [
    (r"ssn|social.security", "{100-899:3}-{10-99:2}-{1000-9999:4}"),
    (r"cvv|cv2|cvc\d?|security.code|card.verification", "{100-999}"),
    (r"credit.card|pan\b|card.number|payment.card", "4{015}"),
    (r"\biban\b|bank.account", "GB{10-99}NWBK{1-9}{013}"),
    (r"salary|income|compensation|wage", "{30-250}{000|500}.00"),
    (r"passport", "{A}{A}{1000000-9999999}"),
    (r"driver.?s?.license|drv.?lic", "{A}{10000000-99999999}"),
    (r"password|secret|credential", "vault://secret/data/key-{100-999}"),
    (r"\bimei\b", "35{013}"),
    (r"\bmac.address|mac.addr\b", "{x2}:{x2}:{x2}:{x2}:{x2}:{x2}"),
    (r"\bip.address|ipv[46]|ip.addr\b", "10.{0-255}.{0-255}.{1-254}"),
    (r"email|e.mail", "user{1-9999}@example.{com|org|net}"),
    (r"phone|telephone|mobile", "+1-555-{100-999:3}-{1000-9999:4}"),
    (r"address|street|location", "{1-9999} {Main|Oak|Cedar|Park|Lake} {St|Ave|Blvd|Rd}"),
    (r"date|timestamp|datetime", "202{0-6}-{1-12:2}-{1-28:2}"),
    (r"\buuid\b|unique.id", "{x8}-{x4}-4{x3}-{x4}-{x12}"),
    (r"url|uri|link|href", "https://example.{com|org}/{docs|api|items}/{1-9999}"),
    (r"amount|price|monetary|cost|payment", "${1-4999}.{0-99:2}"),
    (r"boolean|flag|indicator", "{true|false}"),
    (r"percentage|ratio|rate", "{0-99}.{0-99:2}%"),
    (r"name|person|human", "{Alex|Sam|Jordan|Casey|Morgan|Riley} {Smith|Chen|Garcia|Okafor|Patel|Kim}"),
    (r"country|nation", "{USA|Canada|Germany|Japan|Brazil|India}"),
    (r"city|town", "{New York|Toronto|Berlin|Osaka|Recife|Pune}"),
    (r"region|province", "{California|Ontario|Bavaria|Kansai|Pernambuco}"),
    (r"status|state", "{active|inactive|pending|archived}"),
    (r"count|quantity|number", "{0-100000}"),
    (r"score|rating", "{0-9}.{0-99:2}"),
    (r"description|text|note|comment", "{Reviewed and approved.|Pending follow-up.|No issues found.|Escalated to owner.}"),
    (r"version", "{0-9}.{0-20}.{0-40}"),
    (r"hash|checksum|digest", "{x12}{x12}{x12}{x4}"),
    (r"code|identifier|id$", "CODE-{100-999}"),
]
#: Prefixes of opaque names and of telling ones.
OPAQUE, PREFIXES = ["col_", "attr_", "field_", "var_", "item_", "key_", "ref_", "val_"], ["user_", "customer_", "src_", "raw_"]
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def drawn(place: Column, slot: str) -> Column:
    """A number below 2^60 for a place (text) and a slot."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", place, F.lit(slot))), 1, 15), 16, 10).cast("long")


def pick(place: Column, slot: str, n: int | Column) -> Column:
    return F.pmod(drawn(place, slot), n if isinstance(n, Column) else F.lit(n))


def formatted(place: Column, form: str) -> Column:
    """A value of a format."""
    parts = []
    for k, (plain, hole) in enumerate(re.findall(r"([^{]+)|\{([^}]*)\}", form)):
        slot = f"f{k}"
        if plain:
            parts.append(F.lit(plain))
        elif m := re.fullmatch(r"(\d+)-(\d+)(?::(\d+))?", hole):
            lo, hi, width = int(m[1]), int(m[2]), int(m[3] or 0)
            text = (pick(place, slot, hi - lo + 1) + lo).cast("string")
            parts.append(F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text) if width else text)
        elif m := re.fullmatch(r"x(\d+)", hole):
            parts.append(F.substring(F.md5(F.concat_ws(":", place, F.lit(slot))), 1, int(m[1])))
        elif m := re.fullmatch(r"0(\d\d?)", hole):
            parts.append(F.lpad(pick(place, slot, 10 ** int(m[1])).cast("string"), int(m[1]), "0"))
        elif hole == "A":
            parts.append(F.substring(F.lit(LETTERS[26:]), (pick(place, slot, 26) + 1).cast("int"), F.lit(1)))
        else:
            parts.append(F.get(F.array(*map(F.lit, hole.split("|"))), pick(place, slot, hole.count("|") + 1).cast("int")))
    return F.concat(*parts)


def suggested(text: Column) -> Column:
    """The number of the first format whose words a code's texts have, null without any."""
    return F.coalesce(*[F.when(F.lower(text).rlike(words), F.lit(k)) for k, (words, _) in enumerate(FORMATS)])


def varied(place: Column, value: Column) -> Column:
    """A value near a given one: numbers by up to a tenth; of other texts over three characters three in ten with a letter or digit changed."""
    number = F.regexp_replace(value, ",", "").try_cast("double")
    moved = number * (1 + (pick(place, "jitter", 2001) - 1000) / 10000.0)
    cents = F.floor(F.round(F.abs(moved), 9) * 100 + 0.5).cast("long")
    sign = F.when(moved < 0, F.lit("-")).otherwise(F.lit(""))
    as_number = F.when(value.rlike("[.eE]"), F.concat(sign, F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))).otherwise(moved.cast("long").cast("string"))
    at = (pick(place, "at", F.greatest(F.length(value), F.lit(1))) + 1).cast("int")
    old = F.substring(value, at, F.lit(1))
    new = F.when(old.rlike("[A-Za-z]"), F.substring(F.lit(LETTERS), (pick(place, "letter", 52) + 1).cast("int"), F.lit(1))).when(old.rlike("[0-9]"), pick(place, "digit", 10).cast("string")).otherwise(old)
    edited = F.concat(F.substring(value, F.lit(1), at - 1), new, F.substring(value, at + 1, F.length(value)))
    return F.when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 1e15), as_number).when((F.length(value) > 3) & (pick(place, "edit", 10) < 3), edited).otherwise(value)


def snake(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_|_$", "")


def named(place: Column, label: Column, mnemonic: Column, aliases: Column, opaque: float = 0.3) -> Column:
    """A column's name: a variant of the code's label, mnemonic or aliases, or with a share of ``opaque`` one that says nothing."""
    base = snake(label)
    camel = lambda x: F.concat(F.substring_index(x, "_", 1), F.array_join(F.transform(F.slice(F.split(x, "_"), 2, 100), lambda w: F.initcap(w)), ""))
    more = F.flatten(F.transform(F.transform(F.coalesce(aliases, F.array().cast("array<string>")), snake), lambda a: F.array(a, camel(a))))
    telling = F.concat(F.array(base, camel(base), F.upper(base), F.lower(mnemonic), F.upper(mnemonic)), more, F.array(*[F.concat(F.lit(p), base) for p in PREFIXES]))
    telling = F.array_distinct(F.filter(telling, lambda x: x.isNotNull() & (F.length(x) > 1)))
    letter = lambda slot: F.substring(F.lit(LETTERS[:26]), (pick(place, slot, 26) + 1).cast("int"), F.lit(1))
    kind = pick(place, "kind", 4)
    tail = (
        F.when(kind == 0, (pick(place, "n", 999) + 1).cast("string"))
        .when(kind == 1, F.concat(letter("a"), (pick(place, "n", 99) + 1).cast("string")))
        .when(kind == 2, F.concat(letter("a"), letter("b"), (pick(place, "n", 9) + 1).cast("string")))
        .otherwise(F.concat((pick(place, "n", 9) + 1).cast("string"), F.lit("_"), (pick(place, "m", 9) + 1).cast("string")))
    )
    dark = F.concat(F.get(F.array(*map(F.lit, OPAQUE)), pick(place, "prefix", len(OPAQUE)).cast("int")), tail)
    hidden = pick(place, "opaque", 1000) < int(opaque * 1000)
    return F.when(hidden | (F.size(telling) == 0), dark).otherwise(F.get(telling, pick(place, "name", F.greatest(F.size(telling), F.lit(1))).cast("int")))


def columns(nodes: DataFrame, prototypes: DataFrame, copies: int, rows: int, seed: int = 0, width: int = 10, opaque: float = 0.3, least: int = 3) -> DataFrame:
    """(table, column, code, kind, row_ix, value): ``copies`` columns of ``rows`` values for each code, ``width`` columns a table.

    nodes: (code, label, mnemonic, aliases); prototypes: (code, value). A code with
    ``least`` prototypes gives values near them (kind template), one whose label and
    aliases suggest a format values of that (inferred); others have no columns. Columns go
    into tables in the order of code and copy. Null and empty prototypes are left out.
    """
    given = numbered(prototypes.where("value <> ''").select("code", "value").distinct(), ["code"], [F.col("value")]).select("code", "value", F.col("i").cast("int").alias("nth"))
    n = given.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    words = F.concat_ws(" ", F.col("label"), F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " "))
    kinds = nodes.join(n, "code", "left").withColumn("form", suggested(words)).where("n IS NOT NULL OR form IS NOT NULL")
    wide = kinds.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("place", F.concat_ws(":", F.lit(str(seed)), "code", F.col("copy").cast("string")))
    wide = numbered(wide.withColumnRenamed("n", "_n"), [], [F.col("code"), F.col("copy")])
    table = F.concat(F.lit("synth_"), F.lpad(F.floor(F.col("i") / width).cast("string"), 5, "0"))
    cols = wide.select(table.alias("table"), named(F.col("place"), F.col("label"), F.col("mnemonic"), F.col("aliases"), opaque).alias("column"), "code", F.when(F.col("_n").isNotNull(), "template").otherwise("inferred").alias("kind"), "form", F.col("_n").alias("n"), "place")
    cells = cols.withColumn("row_ix", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("cell", F.concat_ws(":", "place", F.col("row_ix").cast("string")))
    inferred = F.coalesce(*[F.when(F.col("form") == k, formatted(F.col("cell"), form)) for k, (_, form) in enumerate(FORMATS)])
    by_form = cells.where("kind = 'inferred'").withColumn("value", inferred)
    by_template = cells.where("kind = 'template'").withColumn("nth", pick(F.col("cell"), "base", F.col("n")).cast("int")).join(given.withColumnRenamed("value", "base"), ["code", "nth"]).withColumn("value", varied(F.col("cell"), F.col("base")))
    out = ["table", "column", "code", "kind", "row_ix", "value"]
    return by_form.select(*out).unionByName(by_template.select(*out))
