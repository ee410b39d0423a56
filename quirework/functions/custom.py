"""Column expressions over custom attributes, metadata and numbers of inventories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# a part "key:value" of a tag's body, with one colon
_PART = r"(?:^|;) *([^:;]*?) *: *([^:;]*?) *(?=;|$)"


def custom_tags(custom: Column) -> Column:
    """Tags of a string "name {key:value; key:value;} ...": tag_name, offset, length, index (numbers or null) and attrs
    (all of them). A part without exactly one colon is left out; of a key that is given twice the last value counts."""
    pattern = F.lit(r"\b(\w+) ?\{(.*?)\}")
    found = F.arrays_zip(F.regexp_extract_all(custom, pattern, F.lit(1)).alias("name"), F.regexp_extract_all(custom, pattern, F.lit(2)).alias("body"))
    all_of = lambda body, group: F.regexp_extract_all(body, F.lit(_PART), F.lit(group))
    parts = F.transform(found, lambda t: F.struct(t["name"].alias("name"), all_of(t["body"], 1).alias("keys"), all_of(t["body"], 2).alias("values")))

    def attrs(t: Column) -> Column:
        keys, values = t["keys"], t["values"]
        entries = F.arrays_zip(keys.alias("key"), values.alias("value"))
        last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda o: o["key"] == e["key"]))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_arrays(keys, values)).otherwise(F.map_from_entries(last))

    tags = F.transform(parts, lambda t: F.struct(t["name"].alias("name"), attrs(t).alias("attrs")))
    number = lambda t, key: t["attrs"][key].try_cast("int").alias(key)
    return F.transform(tags, lambda t: F.struct(t["name"].alias("tag_name"), number(t, "offset"), number(t, "length"), number(t, "index"), t["attrs"].alias("attrs")))


def tags_named(tags: Column, name: str) -> Column:
    return F.filter(tags, lambda t: t["tag_name"] == name)


def tagged_text(text: Column, tag: Column) -> Column:
    """The part of a line that a tag's offset and length mark; null without them."""
    return text.substr(tag["offset"] + 1, tag["length"])


def metadata_time(value: Column) -> Column:
    """A timestamp from milliseconds since 1970 or from a written date; null if it is neither."""
    return F.coalesce(F.timestamp_millis(F.when(value.rlike(r"^\d+$"), value.try_cast("long"))), F.try_to_timestamp(value))


def number_parts(number: Column) -> Column:
    """Runs of digits, single letters and dots of an inventory number; other signs are left out."""
    return F.regexp_extract_all(number, F.lit(r"(\d+|[A-Za-z]|\.)"), F.lit(1))


def member_parts(path: Column) -> Column:
    """dir, file and extension of a member's path, with / or \\ between folders."""
    file = F.regexp_extract(path, r"([^/\\]*)$", 1)
    folder = F.regexp_replace(F.regexp_replace(path, r"[^/\\]*$", ""), r"[/\\]$", "")
    return F.struct(folder.alias("dir"), file.alias("file"), F.regexp_extract(file, r"(\.[^.]*)$", 1).alias("ext"))
