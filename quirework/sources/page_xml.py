"""PAGE XML documents: reading to normalised frames, and writing.

`parse` makes one row of each file, with its regions, lines and cells as arrays; `regions`, `lines`, `words` and `cells`
make frames of them without a shuffle. Regions may be nested to any depth; a region's path is its places from the page
downwards. Any namespace is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.geometry import hull_points

NAMESPACE = "http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"
_WORD = "word_id string, text string, conf double, points string"
_LINE = f"region_id string, cell_id string, line_id string, pos int, text string, conf double, xheight int, points string, baseline string, custom string, attrs map<string,string>, words array<struct<{_WORD.replace(' ', ':').replace(',:', ',')}>>"
_REGION = "region_id string, parent_id string, path array<int>, depth int, kind string, rank int, type string, orientation double, text string, points string, custom string, attrs map<string,string>, n_lines int"
_CELL = "table_id string, cell_id string, row int, col int, row_span int, cell_span int, header string, cornerpoints string, points string, custom string, value string"


def _struct(ddl: str) -> str:
    out, depth = [], 0
    for part in ddl.split(", "):
        name, kind = part.split(" ", 1)
        out.append(f"{name}:{kind}")
    return "struct<" + ",".join(out) + ">"


SCAN = (
    "filename string, width int, height int, namespace string, creator string, created string, last_change string, ro_id string, ro_caption string, reading_order map<int,string>, "
    f"regions array<{_struct(_REGION)}>, lines array<{_struct(_LINE)}>, cells array<{_struct(_CELL)}>, error string"
)


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


_NAMES: dict[str, str] = {}


def _named(tag: str) -> str:
    name = tag.rpartition("}")[2]
    if len(_NAMES) < 1000:
        _NAMES[tag] = name
    return name


def _kids(e: ElementTree.Element, *names: str) -> list[ElementTree.Element]:
    return e.findall(names[0]) if len(names) == 1 else [k for k in e if k.tag in names]


def _points(e: ElementTree.Element, name: str = "Coords") -> str | None:
    c = e.find(name)
    return (c.get("points") or None) if c is not None else None


def _number(x: str | None, kind=float):
    return None if x in (None, "") else kind(x)


def _text(e: ElementTree.Element) -> tuple[str | None, float | None]:
    t = e.find("TextEquiv")
    if t is None:
        return None, None
    for name in ("Unicode", "PlainText"):
        u = t.find(name)
        if u is not None:
            return u.text, _number(t.get("conf"))
    return (t.text if t.text and t.text.strip() else None), _number(t.get("conf"))


def _has_points(points: str | None) -> bool:
    """Whether there are points in a text; fails where one can't be read."""
    return bool(points) and (_PLAIN(points) is not None or bool(_pairs(points)))


def _pairs(points: str | None) -> list[tuple[int, int]]:
    parts = [p.split(",") for p in (points or "").split()]
    return [(int(p[0]), int(p[1])) for p in parts if len(p) == 2]


# documents of text regions that aren't nested, and of lines without words, are read by patterns, which is faster than a tree
_S = "[ \t\r\n]*"
_CHARS = "\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff"
_VALUE = f'[^"<&\t\n\r{_CHARS}]*'
_ATTRS = f'((?: (?!xmlns=)[A-Za-z_][A-Za-z0-9_.-]*="{_VALUE}")*){_S}>{_S}'
_TEXT = f"([^<>&\r{_CHARS}]*(?:&(?:amp|lt|gt|quot|apos);[^<>&\r{_CHARS}]*)*)"
_EQUIV = f'(?:<TextEquiv(?: conf="({_VALUE})")?>{_S}<Unicode>{_TEXT}</Unicode>{_S}</TextEquiv>{_S})?'
_COORDS = f'(?:<Coords points="({_VALUE})"{_S}/>{_S})?'
_HEAD = re.compile(f'(?:<\\?xml version="1.0" encoding="UTF-8"\\?>{_S})?<PcGts xmlns="({_VALUE})">{_S}(?:<Metadata/>|<Metadata>{_S}((?:<[A-Z][A-Za-z]*>{_TEXT[1:-1]}</[A-Z][A-Za-z]*>{_S})*)</Metadata>){_S}<Page{_ATTRS}').match
_REGION = re.compile(f"<TextRegion{_ATTRS}{_COORDS}").match
_LINE_AT = re.compile(f'<TextLine{_ATTRS}{_COORDS}(?:<Baseline points="({_VALUE})"{_S}/>{_S})?{_EQUIV}</TextLine>{_S}').match
_REGION_END = re.compile(f"{_EQUIV}</TextRegion>{_S}").match
_END = re.compile(f"</Page>{_S}</PcGts>{_S}").fullmatch
_SAID = re.compile("<([A-Za-z]*)>([^<]*)</([A-Za-z]*)>").findall
_ATTR = re.compile(' ([^ =]*)="([^"]*)"').findall


def _plain(text: str | None) -> str | None:
    """The text of an element as it is written without its escapes."""
    if text and "&" in text:
        for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
            text = text.replace(f"&{name};", char)
    return text or None


def _plain_document(content: bytes | str) -> tuple | None:
    """The head of a document and its regions, each with its lines, all as matches; null if the patterns don't hold it."""
    if isinstance(content, bytes):
        try:
            content = content.decode()
        except UnicodeDecodeError:
            return None
    if not isinstance(content, str):
        return None
    head = _HEAD(content)
    if head is None or not head[1]:
        return None
    at, regions = head.end(), []
    while (region := _REGION(content, at)) is not None:
        at, own = region.end(), []
        while (line := _LINE_AT(content, at)) is not None:
            own.append(line)
            at = line.end()
        if (end := _REGION_END(content, at)) is None:
            return None
        at = end.end()
        regions.append((region, own, end))
    return (head, regions) if _END(content, at) else None


def _attrs(text: str) -> dict[str, str] | None:
    """Attributes; null if one is there twice."""
    found = _ATTR(text)
    out = dict(found)
    return out if len(out) == len(found) else None


def _read_plain(content: bytes | str, wanted: dict[str, set[str]] | None) -> dict | None:
    """`parse_document` of a document that the patterns hold; null for others."""
    matches = _plain_document(content)
    if matches is None:
        return None
    head, found = matches
    said = _SAID(head[2] or "")
    page = _attrs(head[3])
    tags = [(_attrs(r[1]), [_attrs(x[1]) for x in own]) for r, own, _ in found]
    if page is None or any(a != b for a, _, b in said) or any(r is None or None in own for r, own in tags):
        return None
    told = {a: _plain(t) for a, t, _ in said}
    out = {"filename": page.get("imageFilename"), "width": _number(page.get("imageWidth"), int), "height": _number(page.get("imageHeight"), int), "namespace": head[1], "creator": told.get("Creator"), "created": told.get("Created"), "last_change": told.get("LastChange"), "ro_id": None, "ro_caption": None, "reading_order": []}
    regions: list[dict] = []
    lines: list[dict] = []
    attrs = wanted is None or "attrs" in wanted["lines"]
    for k, ((region, own, end), (tag, line_tags)) in enumerate(zip(found, tags)):
        _number(end[1])  # not kept, but it may fail
        name = tag.get("id")
        me = {"region_id": name, "parent_id": None, "path": [k], "depth": 1, "kind": "text_region", "rank": None, "type": tag.get("type"), "orientation": _number(tag.get("orientation")), "text": _plain(end[2]), "points": region[2] or None, "custom": tag.get("custom"), "attrs": list(tag.items()), "n_lines": len(own)}
        inner = []
        for x, t in zip(own, line_tags):
            _, points, baseline, conf, text = x.groups()
            lines.append({"region_id": name, "cell_id": None, "line_id": t.get("id"), "pos": len(lines), "text": _plain(text), "conf": _number(conf), "xheight": _number(t.get("xheight"), int), "points": points or None, "baseline": baseline or None, "custom": t.get("custom"), "attrs": list(t.items()) if attrs else None, "words": []})
            inner.append(points)
        inner = [p for p in inner if _has_points(p)]
        if me["points"] is None:
            if not inner and not own:
                continue
            if inner:
                me["points"] = " ".join(f"{x},{y}" for x, y in hull_points(p for i in inner for p in _pairs(i)))
        _has_points(me["points"])
        regions.append(me)
    for n, r in enumerate(regions):
        r["rank"] = n + 1
    return out | {"regions": regions, "lines": lines, "cells": [], "error": None}


#: points of which nothing can fail and of which there is one at least
_PLAIN = re.compile(r"[0-9]+,[0-9]+(?: [0-9]+,[0-9]+)*").fullmatch


def parse_document(content: bytes | str, wanted: dict[str, set[str]] | None = None) -> dict:
    """A row of SCAN of one document. A file that isn't PAGE XML fails.

    `wanted` names the fields of regions, lines and cells that are asked for; of the others those that cost time may be
    left out, but are read as far as they may fail.
    """
    if (plain := _read_plain(content, wanted)) is not None:
        return plain
    root = ElementTree.fromstring(content)
    namespace = root.tag[1:].partition("}")[0] if root.tag[0] == "{" else None
    for e in root.iter():  # names without their namespace are found faster
        tag = e.tag
        if isinstance(tag, str) and tag[0] == "{":
            e.tag = _NAMES.get(tag) or _named(tag)
    if root.tag != "PcGts":
        raise ValueError("the root isn't PcGts")
    page, meta = root.find("Page"), root.find("Metadata")
    if page is None:
        raise ValueError("there is no Page")
    said = {k.tag: k.text for k in meta} if meta is not None else {}
    out = {"filename": page.get("imageFilename"), "width": _number(page.get("imageWidth"), int), "height": _number(page.get("imageHeight"), int), "namespace": namespace, "creator": said.get("Creator"), "created": said.get("Created"), "last_change": said.get("LastChange"), "ro_id": None, "ro_caption": None, "reading_order": []}
    order = page.find("ReadingOrder")
    group = order.find("OrderedGroup") if order is not None else None
    if group is not None:
        out |= {"ro_id": group.get("id"), "ro_caption": group.get("caption"), "reading_order": [(int(r.get("index")), r.get("regionRef")) for r in _kids(group, "RegionRefIndexed")]}
    regions: list[dict] = []
    lines: list[dict] = []
    cells: list[dict] = []
    line_attrs = wanted is None or "attrs" in wanted["lines"]
    baselines = wanted is None or "baseline" in wanted["lines"]

    def add_lines(e: ElementTree.Element, region: str | None, cell: str | None) -> list[dict]:
        own = []
        at = len(lines)
        for t in e.findall("TextLine"):
            text, conf = _text(t)
            words = []
            for w in t.findall("Word"):
                word, word_conf = _text(w)
                if word is not None:
                    words.append({"word_id": w.get("id"), "text": word, "conf": word_conf, "points": _points(w)})
            own.append({"region_id": region, "cell_id": cell, "line_id": t.get("id"), "pos": at + len(own), "text": text, "conf": conf, "xheight": _number(t.get("xheight"), int), "points": _points(t), "baseline": _points(t, "Baseline") if baselines else None, "custom": t.get("custom"), "attrs": list(t.attrib.items()) if line_attrs else None, "words": words})
        lines.extend(own)
        return own

    def add_region(e: ElementTree.Element, parent: str | None, path: list[int]) -> list[str]:
        """The points of the region, or of what it holds, as they are written."""
        text, _ = _text(e)
        me = {"region_id": e.get("id"), "parent_id": parent, "path": path, "depth": len(path), "kind": "table_region" if e.tag == "TableRegion" else "text_region", "rank": None, "type": e.get("type"), "orientation": _number(e.get("orientation")), "text": text, "points": _points(e), "custom": e.get("custom"), "attrs": list(e.attrib.items())}
        at = len(regions)
        regions.append(me)
        inner: list[str] = []
        for k, sub in enumerate(_kids(e, "TextRegion", "TableRegion")):  # lines of regions inside come before its own
            inner += add_region(sub, me["region_id"], [*path, k])
        if me["kind"] == "table_region":
            own = []
            for c in e.findall("TableCell"):
                cell_lines = add_lines(c, me["region_id"], c.get("id"))
                own += cell_lines
                corner = c.find("CornerPts")
                value = " ".join(x["text"] for x in cell_lines if x["text"] is not None)
                cells.append({"table_id": me["region_id"], "cell_id": c.get("id"), "row": _number(c.get("row"), int), "col": _number(c.get("col"), int), "row_span": _number(c.get("rowSpan"), int), "cell_span": _number(c.get("cellSpan") or c.get("colSpan"), int), "header": c.get("header"), "cornerpoints": corner.text if corner is not None else None, "points": _points(c), "custom": c.get("custom"), "value": value})
        else:
            own = add_lines(e, me["region_id"], None)
        me["n_lines"] = len(own)
        inner += [x["points"] for x in own if _has_points(x["points"])]
        if me["points"] is None and inner:
            me["points"] = " ".join(f"{x},{y}" for x, y in hull_points(p for i in inner for p in _pairs(i)))
        if me["points"] is None and len(regions) == at + 1 and not own:
            regions.pop()  # neither a place nor a content
            return []
        return [me["points"]] if _has_points(me["points"]) else inner

    for k, e in enumerate(_kids(page, "TextRegion", "TableRegion")):
        add_region(e, None, [k])
    top = [r for r in regions if r["depth"] == 1]
    place = {r: i for i, r in sorted(out["reading_order"], reverse=True)}
    whole = bool(place) and all(r["region_id"] in place for r in top)
    for n, r in enumerate(sorted(top, key=lambda r: (place[r["region_id"]] if whole else 0, r["path"]))):
        r["rank"] = n + 1
    return out | {"regions": regions, "lines": lines, "cells": cells, "error": None}


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """An Arrow array of a type; arrays of structs are built field by field, which is much faster than value by value."""
    if not pa.types.is_list(kind) or not pa.types.is_struct(kind.value_type):
        return pa.array(values, kind)
    flat = [x for v in values if v for x in v]
    fields = list(kind.value_type)
    structs = pa.StructArray.from_arrays([_column([x[f.name] for x in flat], f.type) for f in fields], fields=fields) if flat else pa.array([], kind.value_type)
    ends = np.append(0, np.cumsum([len(v) if v else 0 for v in values])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), structs, type=kind, mask=pa.array([v is None for v in values]))


def parse(files: DataFrame, *, content: str = "content", keep: tuple[str, ...] = ("path",), mode: str = "permissive", encoding: str = "utf-8", fields: dict[str, list[str]] | None = None) -> DataFrame:
    """The columns `keep` and SCAN of each row with a document in `content` (binary or string).

    With `fields`, of SCAN only the error and the fields named of regions, lines and cells, in their columns; so only
    these are made. Documents that can't be read are the same.

    A document that can't be read has null fields and its error; with mode failfast it ends the job. Null gives an error, too.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    scan = StructType.fromDDL(SCAN).fields
    wanted = None
    if fields is not None:
        wanted = {n: set(fields.get(n, [])) for n in ("regions", "lines", "cells")}
        for f in scan:
            if wanted.get(f.name):
                f.dataType.elementType = StructType([x for x in f.dataType.elementType.fields if x.name in wanted[f.name]])
        scan = [f for f in scan if wanted.get(f.name) or f.name == "error"]
    schema = StructType([*[files.schema[c] for c in keep], *scan])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                rows = []
                for kept, data in zip(part.select(list(keep)).to_pylist(), part.column(part.num_columns - 1)):
                    try:
                        data = data.as_py()
                        if isinstance(data, bytes) and encoding.lower() != "utf-8":
                            data = data.decode(encoding)
                        rows.append(kept | parse_document(data, wanted))
                    except Exception as e:
                        if mode == "failfast":
                            raise ValueError(f"{kept}: {e}") from e
                        rows.append(kept | {"error": f"{type(e).__name__}: {e}"})
                yield pa.RecordBatch.from_arrays([_column([r.get(f.name) for r in rows], f.type) for f in arrow], schema=arrow)

    return files.select(*keep, F.col(content).alias("__content")).mapInArrow(run, schema)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """All .xml files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(path)
    return parse(files, **options)


def read_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """The same files as they arrive in the folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(path)
    return parse(files, **options)


def _exploded(scans: DataFrame, column: str, keys: list[str]) -> DataFrame:
    return scans.select(*keys, F.explode(column).alias("__e")).select(*keys, "__e.*")


def regions(scans: DataFrame, keys: list[str] = ["path"]) -> DataFrame:
    """A row for each region; its path in the document is `region_path`."""
    out = scans.select(*keys, F.explode("regions").alias("__e"))
    names = [f.name for f in out.schema["__e"].dataType.fields]
    return out.select(*keys, *[F.col(f"__e.{n}").alias("region_path" if n == "path" else n) for n in names])


def lines(scans: DataFrame, keys: list[str] = ["path"]) -> DataFrame:
    return _exploded(scans, "lines", keys)


def cells(scans: DataFrame, keys: list[str] = ["path"]) -> DataFrame:
    return _exploded(scans, "cells", keys)


def words(scans: DataFrame, keys: list[str] = ["path"]) -> DataFrame:
    """The words of each line: those it lists, else the parts of its text between single spaces."""
    own = lines(scans, keys)
    given = F.transform("words", lambda w: w["text"])
    listed = F.when(F.size("words") > 0, given).when(F.length("text") > 0, F.split("text", " ", -1)).otherwise(F.array().cast("array<string>"))
    return own.select(*keys, "region_id", "line_id", F.posexplode(listed).alias("word_pos", "word"))


def stats(scans: DataFrame) -> DataFrame:
    """Counts of regions, tables, lines, words, characters and cells of each document, without a shuffle."""
    n_words = lambda x: F.when(F.size(x["words"]) > 0, F.size(x["words"])).when(F.length(x["text"]) > 0, F.size(F.split(x["text"], " ", -1))).otherwise(0)
    total = lambda col: F.aggregate(col, F.lit(0), lambda a, v: a + v)
    return scans.select("path", F.size(F.filter("regions", lambda r: r["kind"] == "text_region")).alias("text_regions"), F.size(F.filter("regions", lambda r: r["kind"] == "table_region")).alias("table_regions"), F.size("lines").alias("lines"), total(F.transform("lines", n_words)).alias("words"), total(F.transform("lines", lambda x: F.coalesce(F.length(x["text"]), F.lit(0)))).alias("chars"), F.size("cells").alias("cells"))


def table_grid(cell_rows: DataFrame, n_columns: int, keys: list[str] = ["path"]) -> DataFrame:
    """A row for each row of each table, its values in the columns c0, c1, ...; an absent cell is an empty text."""
    got = cell_rows.groupBy(*keys, "table_id", "row").pivot("col", list(range(n_columns))).agg(F.first("value"))
    return got.select(*keys, "table_id", "row", *[F.coalesce(F.col(f"`{i}`"), F.lit("")).alias(f"c{i}") for i in range(n_columns)])


# which elements may stand in which, and of which there is one at most
CHILDREN = {
    "PcGts": ["Metadata", "Page"],
    "Metadata": ["Creator", "Created", "LastChange", "Comments"],
    "Page": ["ReadingOrder", "TextRegion", "TableRegion"],
    "ReadingOrder": ["OrderedGroup"],
    "OrderedGroup": ["RegionRefIndexed"],
    "TextRegion": ["Coords", "TextRegion", "TableRegion", "TextLine", "TextEquiv"],
    "TableRegion": ["Coords", "TableCell"],
    "TableCell": ["Coords", "CornerPts", "TextLine"],
    "TextLine": ["Coords", "Baseline", "Word", "TextEquiv"],
    "Word": ["Coords", "TextEquiv"],
    "TextEquiv": ["Unicode", "PlainText"],
}
SINGLE = {("PcGts", "Metadata"), ("PcGts", "Page"), ("Page", "ReadingOrder"), *((p, c) for p, kids in CHILDREN.items() for c in kids if c in ("Coords", "Baseline", "TextEquiv", "CornerPts", "Unicode", "PlainText", "Creator", "Created", "LastChange"))}


def violations(content: str) -> list[str]:
    """What in a document breaks the rules of nesting."""
    out = []
    for parent in ElementTree.fromstring(content).iter():
        seen = set()
        for kid in parent:
            rule = (_tag(parent), _tag(kid))
            if rule[1] not in CHILDREN.get(rule[0], []):
                out.append(f"{rule[1]} in {rule[0]}")
            elif rule in SINGLE and rule in seen:
                out.append(f"a second {rule[1]} in {rule[0]}")
            seen.add(rule)
    return out


def _attr(name: str, value: Column) -> Column:
    safe = F.replace(F.replace(F.replace(value.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    return F.when(value.isNotNull(), F.concat(F.lit(f' {name}="'), safe, F.lit('"'))).otherwise("")


def _escaped(value: Column) -> Column:
    return F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _equiv(text: Column, conf: Column | None = None) -> Column:
    head = F.concat(F.lit("<TextEquiv"), _attr("conf", conf) if conf is not None else F.lit(""), F.lit("><Unicode>"))
    return F.when(text.isNotNull(), F.concat(head, _escaped(text), F.lit("</Unicode></TextEquiv>"))).otherwise("")


def _shape(name: str, points: Column) -> Column:
    return F.when(points.isNotNull(), F.concat(F.lit(f"<{name}"), _attr("points", points), F.lit("/>"))).otherwise("")


def to_xml(line_rows: DataFrame, keys: list[str], *, order: str = "pos", size: tuple[str, str] | None = None) -> DataFrame:
    """`keys` (the first names the image) and content, a PAGE XML document, from lines (region_id, line_id, order, text, points, baseline; x, y, r and b
    of each, if there, save reading the points).

    Regions have the boxes around their lines and stand in the order of their names. Strings are put together in the JVM.
    """
    c = F.col
    line = F.concat(F.lit("<TextLine"), _attr("id", c("line_id")), _attr("custom", c("custom")) if "custom" in line_rows.columns else F.lit(""), F.lit(">"), _shape("Coords", c("points")), _shape("Baseline", c("baseline")), _equiv(c("text")), F.lit("</TextLine>"))
    pts = G.Box.of() if {"x", "y", "r", "b"} <= set(line_rows.columns) else G.Box.around(G.points(c("points")))
    cols = line_rows.select(*keys, "region_id", c(order).alias("__o"), line.alias("__l"), pts.x.alias("x"), pts.y.alias("y"), pts.r.alias("r"), pts.b.alias("b"))
    # one shuffle for both
    region = cols.repartition(*keys).groupBy(*keys, "region_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("__o", "__l")))["__l"], "").alias("body"), F.min("x").alias("x"), F.min("y").alias("y"), F.max("r").alias("r"), F.max("b").alias("b"))
    corners = F.when(c("x").isNotNull(), G.Box.of().corners())
    xml = F.concat(F.lit("<TextRegion"), _attr("id", c("region_id")), F.lit(">"), _shape("Coords", corners), c("body"), F.lit("</TextRegion>"))
    page = region.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(F.struct("region_id", xml.alias("x"))))["x"], "").alias("body"), F.max("r").alias("w"), F.max("b").alias("h"))
    head = F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><PcGts xmlns="{NAMESPACE}"><Metadata/><Page'), _attr("imageFilename", c(keys[0]).cast("string")), _attr("imageWidth", c("w")), _attr("imageHeight", c("h")), F.lit(">"))
    return page.select(*keys, F.concat(head, c("body"), F.lit("</Page></PcGts>")).alias("content"))


def document_xml(scan: dict) -> str:
    """One parsed document (a row of SCAN) written again, with nested regions, tables, words and its reading order."""
    a = lambda **k: "".join(f" {n}={quoteattr(str(v))}" for n, v in k.items() if v is not None)
    shape = lambda name, p: f"<{name} points={quoteattr(p)}/>" if p else ""
    equiv = lambda t, conf=None: f"<TextEquiv{a(conf=conf)}><Unicode>{escape(t)}</Unicode></TextEquiv>" if t is not None else ""

    def line(x: dict) -> str:
        inner = "".join(f"<Word{a(id=w['word_id'])}>{shape('Coords', w['points'])}{equiv(w['text'], w['conf'])}</Word>" for w in x["words"] or [])
        return f"<TextLine{a(id=x['line_id'], custom=x['custom'], xheight=x['xheight'])}>{shape('Coords', x['points'])}{shape('Baseline', x['baseline'])}{inner}{equiv(x['text'], x['conf'])}</TextLine>"

    def region(r: dict) -> str:
        head = a(id=r["region_id"], type=r["type"], orientation=r["orientation"], custom=r["custom"])
        subs = "".join(region(s) for s in scan["regions"] if s["parent_id"] == r["region_id"] and s["depth"] == r["depth"] + 1)
        if r["kind"] == "table_region":
            body = ""
            for c in scan["cells"]:
                if c["table_id"] == r["region_id"]:
                    corner = f"<CornerPts>{escape(c['cornerpoints'])}</CornerPts>" if c["cornerpoints"] else ""
                    own = "".join(line(x) for x in scan["lines"] if x["region_id"] == r["region_id"] and x["cell_id"] == c["cell_id"])
                    body += f"<TableCell{a(id=c['cell_id'], row=c['row'], col=c['col'], rowSpan=c['row_span'], cellSpan=c['cell_span'], header=c['header'], custom=c['custom'])}>{shape('Coords', c['points'])}{corner}{own}</TableCell>"
            return f"<TableRegion{head}>{shape('Coords', r['points'])}{body}</TableRegion>"
        own = "".join(line(x) for x in scan["lines"] if x["region_id"] == r["region_id"] and x["cell_id"] is None)
        return f"<TextRegion{head}>{shape('Coords', r['points'])}{subs}{own}{equiv(r['text'])}</TextRegion>"

    order = "".join(f"<RegionRefIndexed{a(index=i, regionRef=r)}/>" for i, r in sorted(dict(scan["reading_order"] or {}).items()))
    order = f"<ReadingOrder><OrderedGroup{a(id=scan['ro_id'], caption=scan['ro_caption'])}>{order}</OrderedGroup></ReadingOrder>" if order else ""
    meta = "".join(f"<{n}>{escape(scan[k])}</{n}>" for n, k in (("Creator", "creator"), ("Created", "created"), ("LastChange", "last_change")) if scan[k])
    body = "".join(region(r) for r in scan["regions"] if r["depth"] == 1)
    return f'<?xml version="1.0" encoding="UTF-8"?><PcGts xmlns="{NAMESPACE}"><Metadata>{meta}</Metadata><Page{a(imageFilename=scan["filename"], imageWidth=scan["width"], imageHeight=scan["height"])}>{order}{body}</Page></PcGts>'
