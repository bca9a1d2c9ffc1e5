"""File sources and sinks: clause arrays, annotation sets, drawings in SVG, split lists, versioned tables, reports."""

from __future__ import annotations

import json
import re
import time
import uuid
import xml.etree.ElementTree as ET

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

CLAUSE = "mabhas_part string, article_id string, heading_fa string, text_fa string, text_en string, skip_category string, applicable_occupancies array<string>, applicable_height_groups array<string>, rule_type string, entities string"
COCO = "images array<struct<id:long,file_name:string,width:int,height:int>>, annotations array<struct<id:long,image_id:long,category_id:int,segmentation:array<array<double>>,bbox:array<double>,area:double,iscrowd:int>>, categories array<struct<id:int,name:string>>"


def _absent(e: AnalysisException) -> bool:
    return e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def clauses(spark: SparkSession, path: str, keep_skipped: bool = False, schema: str = CLAUSE) -> DataFrame:
    """Clauses of JSON array files with a fixed schema, to which a caller may add members; unreadable records are left out, a missing file has none."""
    whole = f"{schema}, _corrupt_record string"
    try:
        df = spark.read.schema(whole).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as e:
        if not _absent(e):
            raise
        return spark.createDataFrame([], schema)
    # All columns are asked for, else the reader does not see that a record is corrupt.
    df = df.where(F.struct("*").isNotNull() & F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    return df if keep_skipped else df.where("coalesce(skip_category, '') = ''")


def coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of annotation files in the common JSON layout."""
    doc = spark.read.schema(COCO).option("multiLine", True).json(path)
    return tuple(doc.select(F.inline(c)) for c in ("images", "annotations", "categories"))


def annotated_images(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Images that have an annotation of area >= 4 and sides >= 2, with these in a list ordered by id."""
    good = annotations.where("area >= 4 and bbox[2] >= 2 and bbox[3] >= 2")
    per = good.groupBy(F.col("image_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("*"))).alias("annotations"))
    return images.join(per, "id")


def split_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a split file without blank ones, comments and outer slashes."""
    line = F.regexp_replace(F.trim("value"), "^/+|/+$", "")
    return spark.read.text(path).where("trim(value) <> '' and not trim(value) like '#%'").select(line.alias("item"))


_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
_TOKEN = re.compile(r"[A-Za-z]|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")


def path_rings(d: str) -> list[list[tuple[float, float]]]:
    """Point lists of an SVG path of straight commands; a curve ends its subpath, numbers before a command are skipped."""
    rings, ring, x, y, command, numbers = [], [], 0.0, 0.0, "", []
    need = {"M": 2, "L": 2, "H": 1, "V": 1}

    def close():
        nonlocal ring
        if len(ring) > 1:
            rings.append(ring)
        ring = []

    for token in _TOKEN.findall(d or ""):
        if token.isalpha():
            command, numbers = token, []
            if token in "Zz":
                close()
            elif token in "Mm":
                close()
            elif token.upper() not in need:
                close()
                command = ""
            continue
        if not command or command in "Zz":
            continue
        numbers.append(float(token))
        kind = command.upper()
        if len(numbers) == need[kind]:
            moved = command.islower()
            if kind == "H":
                x = numbers[0] + (x if moved else 0)
            elif kind == "V":
                y = numbers[0] + (y if moved else 0)
            else:
                x, y = numbers[0] + (x if moved else 0), numbers[1] + (y if moved else 0)
            ring.append((x, y))
            numbers = []
            if kind == "M":
                command = "l" if moved else "L"
    close()
    return rings


@udtf(returnType="label string, place int, points array<struct<x:double,y:double>>")
class SvgPolygons:
    """Polygons of an SVG drawing with the label of the nearest group above them; an unreadable drawing has none."""

    def eval(self, text: str):
        try:
            root = ET.fromstring(text or "")
        except ET.ParseError:
            return
        place, todo = 0, [(root, None)]
        while todo:
            node, label = todo.pop()
            label = node.get("class") or node.get("id") or label
            kind = node.tag.rsplit("}", 1)[-1]
            rings = []
            if kind in ("polygon", "polyline"):
                n = [float(v) for v in _NUMBER.findall(node.get("points", ""))]
                rings = [list(zip(n[::2], n[1::2]))]
            elif kind == "path":
                rings = path_rings(node.get("d", ""))
            for r in rings:
                if len(r) >= 3:
                    yield label, place, r
                    place += 1
            todo.extend((child, label) for child in reversed(list(node)))


def svg_polygons(drawings: DataFrame, id_col: str = "drawing_id", text: str = "svg") -> DataFrame:
    """(id, label, place, points) of each drawing, by a lateral join with the table function."""
    spark = drawings.sparkSession
    spark.udtf.register("planweave_svg_polygons", SvgPolygons)
    return spark.sql(f"SELECT d.{id_col}, p.* FROM {{d}} d, LATERAL planweave_svg_polygons(d.{text}) p", d=drawings)


#: Seconds after which a taken version number whose writer has not published it is free again.
STALE_S = 300


class VersionConflict(RuntimeError):
    """Another writer has published a version since the one this write began from."""


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, folder: str) -> list[tuple[int, str, str]]:
    """(number, name of its data, tag) of each published version, the last one last; none where the folder is missing.

    A version is published by one rename of a file that did not exist before, whose name says all there is to know.
    Only a missing folder counts as none: other errors of the file system are raised.
    """
    fs, path = _files(spark, f"{folder}/log")
    try:
        names = [s.getPath().getName() for s in fs.listStatus(path)]
    except Exception as e:
        if "FileNotFoundException" in str(e):
            return []
        raise
    found = [n.split("~") for n in names if n.endswith("~done")]
    return sorted((int(n[0]), n[1], n[2]) for n in found)


def write_version(df: DataFrame, folder: str, tag: str = "", after: int | None = None) -> int:
    """df written beside earlier versions and published under the next number, which is returned.

    Readers see the version before or this one, never none.  after: the number the write began from; if another
    writer has published since, nothing is published and VersionConflict is raised.  tag: a name of the write, such
    as a batch id, by which a repeated write can be told; letters, digits, - and _ only.
    """
    if not re.fullmatch(r"[\w-]*", tag):
        raise ValueError("a tag has letters, digits, - and _ only")
    spark, data = df.sparkSession, f"v-{uuid.uuid4().hex}"
    last = max((v[0] for v in versions(spark, folder)), default=0) if after is None else after
    df.write.parquet(f"{folder}/{data}")
    fs, log = _files(spark, f"{folder}/log")
    fs.mkdirs(log)
    hadoop = spark._jvm.org.apache.hadoop.fs
    # The number is taken by creating a file that must not exist yet; the rename, at once after it, says what it holds.
    claim = hadoop.Path(f"{folder}/log/{last + 1}~claim")
    if fs.exists(claim) and time.time() * 1000 - fs.getFileStatus(claim).getModificationTime() > STALE_S * 1000:
        fs.delete(claim, False)
    if not fs.createNewFile(claim) or any(v[0] > last for v in versions(spark, folder)):
        raise VersionConflict(f"version {last + 1} of {folder} is taken")
    if not fs.rename(claim, hadoop.Path(f"{folder}/log/{last + 1}~{data}~{tag}~done")):
        raise VersionConflict(f"version {last + 1} of {folder} could not be published")
    return last + 1


def read_version(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The last published version; an empty table where there is none. A version that cannot be read raises."""
    found = versions(spark, folder)
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{folder}/{found[-1][1]}")


def write_coco(images: DataFrame, annotations: DataFrame, categories: list[tuple[int, str]], path: str) -> None:
    """Annotation sets as JSON, one document per image, so that no task holds the whole set."""
    per = annotations.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(*annotations.columns))).alias("annotations"))
    doc = images.join(per, images["id"] == per["image_id"], "left").select(F.to_json(F.struct(F.array(F.struct(*[images[c] for c in images.columns])).alias("images"), "annotations", F.from_json(F.lit(json.dumps([{"id": i, "name": n} for i, n in categories])), "array<struct<id:int,name:string>>").alias("categories"))).alias("value"))
    doc.write.mode("overwrite").text(path)


def escaped(col):
    """Text for markup."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


def report_rows(findings: DataFrame) -> DataFrame:
    """Findings as report lines: order by verdict then article, a short title and a markup row."""
    rank = F.when(F.col("verdict") == "FAIL", 0).when(F.col("verdict") == "NEEDS_REVIEW", 1).when(F.col("verdict") == "PASS", 2).otherwise(3)
    title = F.when(F.length("message") > 70, F.concat(F.left("message", F.lit(70)), F.lit("…"))).otherwise(F.col("message"))
    row = F.format_string("<tr><td>%s</td><td>%s</td><td>%s</td></tr>", escaped(F.coalesce("article_id", F.lit(""))), escaped(F.coalesce("verdict", F.lit(""))), escaped(F.coalesce(title, F.lit(""))))
    return findings.withColumns({"verdict_rank": rank, "title": title, "markup": row})


def shortened(text, most: int):
    """A text of at most so many characters, the last one a mark of what was left out."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def issue_topics(findings: DataFrame) -> DataFrame:
    """Findings that fail or are open as issue topics: a title of at most 200 characters, a stable guid and a markup document each."""
    v = F.upper(F.trim("verdict"))
    out = findings.where(v.isin("FAIL", "NEEDS_REVIEW")).withColumns({"priority": v, "title": shortened(F.col("message"), 200)})
    h = F.md5(F.concat_ws("|", F.col("finding_id").cast("string"), "plan_id", "article_id"))
    guid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    body = F.format_string('<Markup><Topic Guid="%s" TopicStatus="Open"><Title>%s</Title><Priority>%s</Priority></Topic></Markup>', guid, escaped(F.coalesce("title", F.lit(""))), F.col("priority"))
    return out.withColumns({"guid": guid, "markup": body})


def write_topics(findings: DataFrame, path: str) -> None:
    """Issue topics as one JSON line each (guid, markup), from which an archive can be put together without the findings."""
    issue_topics(findings).select("finding_id", "guid", "priority", "title", "markup").write.mode("overwrite").json(path)


def write_report(findings: DataFrame, path: str, title: str = "Report") -> None:
    """Findings as HTML parts in report order, one file a range of the order: a head, rows, no part larger than its range."""
    rows = report_rows(findings).orderBy("verdict_rank", F.col("article_id").cast("string"), "finding_id")
    rows.select(F.col("markup").alias("value")).write.mode("overwrite").text(f"{path}/rows")
    head = f"<html><head><title>{title}</title></head><body><table>"
    findings.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")


def append_log(df: DataFrame, path: str) -> None:
    """Rows added to an append-only log; readers take the last of each key (``keyed.latest``)."""
    df.write.mode("append").parquet(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Rows added to CSV files with a header; nulls are empty."""
    df.write.mode("append").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def conversion_report(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """(name, n): images with and without annotations, and annotations of each category, zeros included."""
    has = annotations.select(F.col("image_id").alias("id")).distinct().withColumn("has", F.lit(True))
    i = images.join(has, "id", "left").groupBy(F.when(F.col("has"), "converted").otherwise("skipped").alias("name")).agg(F.count("*").alias("n"))
    c = categories.join(annotations.groupBy(F.col("category_id").alias("id")).agg(F.count("*").alias("n")), "id", "left")
    return i.unionByName(c.select("name", F.coalesce("n", F.lit(0)).alias("n")))


def png_size(content):
    """(width, height) of a PNG file's bytes, from its header; null for other files."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("width"), number(21).alias("height")))


def view_box(text, width, height):
    """(sx, sy, dx, dy): scale and offset from a drawing's view box "x y w h" to pixels; 1 and 0 where it has none."""
    p = F.transform(F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), ",", " ")), r"\s+"), lambda v: v.try_cast("double"))
    ok = (F.size(p) == 4) & F.forall(p, lambda v: v.isNotNull()) & (F.get(p, 2) > 0) & (F.get(p, 3) > 0)
    sx, sy = F.try_divide(width.cast("double"), F.get(p, 2)), F.try_divide(height.cast("double"), F.get(p, 3))
    one, zero = F.lit(1.0), F.lit(0.0)
    return F.struct(
        F.when(ok, sx).otherwise(one).alias("sx"), F.when(ok, sy).otherwise(one).alias("sy"), F.when(ok, -F.get(p, 0) * sx).otherwise(zero).alias("dx"), F.when(ok, -F.get(p, 1) * sy).otherwise(zero).alias("dy")
    )


def class_of(tokens, element_id, title, known: dict[str, int]):
    """Class of a drawn element: of the first class token that is known, else of its id, of its id without a number, of its title; null if none is."""
    table = F.create_map(*[F.lit(x) for k, v in known.items() for x in (k.lower(), v)])
    look = lambda t: F.try_element_at(table, F.lower(F.trim(t)))
    first = F.get(F.filter(F.transform(F.split(F.coalesce(tokens, F.lit("")), r"\s+"), look), lambda v: v.isNotNull()), 0)
    return F.coalesce(first, look(element_id), look(F.regexp_replace(element_id, r"[-_ ]*\d+$", "")), look(title))


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """df with values that are missing or cannot be read as the default's type replaced by it; missing columns are added."""
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    out = {}
    for name, value in defaults.items():
        have = F.col(name).cast("string").try_cast(kinds[type(value)]) if name in df.columns else F.lit(None).cast(kinds[type(value)])
        out[name] = F.coalesce(have, F.lit(value))
    return df.withColumns(out)


def paragraphs(df: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, pos, style, text) of the paragraphs of plain texts that are not blank; a line of marks # before a heading tells its style."""
    p = df.select(doc, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line")).where(F.trim("line") != "")
    level = F.length(F.regexp_extract("line", r"^(#+)\s", 1))
    return p.select(doc, "pos", F.when(level > 0, F.concat(F.lit("Heading "), level)).otherwise("Normal").alias("style"), F.trim(F.regexp_replace("line", r"^#+\s+", "")).alias("text"))
