"""Readers and writers of project files: manifests, score tables, image folders, page archives."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import natural_key

MANIFEST = """
version int, source string, sources array<string>, source_type string, status string, expected_page_count int, config map<string,string>,
spreads array<struct<id: string, start: double, end: double, duplicate_of: string, selected: int,
  candidates: array<struct<id: int, time: double, metrics: struct<score: double, sharpness: double, motion: double, hand_overlap: double, glare_overlap: double>, suspect: array<string>>>>>,
pages array<struct<id: string, spread_id: string, side: string, candidate_id: int, enabled: boolean, suspect: array<string>, final_quality: struct<reasons: array<string>>>>
"""


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row per manifest below ``path`` (a glob is fine); older versions are brought up to date on reading."""
    raw = spark.read.schema(MANIFEST).json(path, multiLine=True)
    return migrate(raw.drop("project").withColumn("project", _project_of(F.input_file_name())))


def _project_of(file: Column) -> Column:
    """The name of the project whose folder holds a file; null for the folder of rows without a project.

    A file's name is given as a URI, in which the writer's folder names, that
    have escapes of their own, are escaped once more.
    """
    plain = lambda x: F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    folder = plain(F.element_at(F.split(file, "/"), -2))
    name = plain(F.substr(folder, F.lit(len("project=") + 1)))
    return F.when(folder == "project=__HIVE_DEFAULT_PARTITION__", F.lit(None)).when(F.startswith(folder, F.lit("project=")), name).otherwise(folder)


#: Oldest and newest version, and what an older manifest means where it leaves a setting out.
OLDEST, NEWEST = 1, 3
OLDER_SETTINGS = {
    "output_layout": "split",
    "candidate_selection_mode": "spread",
    "perspective_mode": "spread",
    "page_background_fill": "preserve",
    "finger_repair": "false",
    "glare_repair": "false",
    "finger_repair_fallback": "preserve",
    "glare_overlap_weight": "0.0",
    "suspect_glare_overlap": "1.0",
    "illumination_correction": "false",
    "white_normalization": "false",
    "auto_rotation": "false",
}


def migrate(manifests: DataFrame) -> DataFrame:
    """Manifests of any version as those of the newest.

    Missing lists become empty, a missing page flag means enabled, no version
    means the oldest. Settings that an older manifest leaves out keep what they
    meant then; a correction by strength alone was a manual one. A version that
    isn't known fails.
    """
    spreads = F.coalesce("spreads", F.array().cast(manifests.schema["spreads"].dataType))
    pages = F.coalesce("pages", F.array().cast(manifests.schema["pages"].dataType))
    fixed = F.transform(pages, lambda p: p.withField("enabled", F.coalesce(p["enabled"], F.lit(True))))
    version = F.coalesce("version", F.lit(OLDEST))
    config = F.coalesce("config", F.create_map().cast("map<string,string>"))
    strength = F.coalesce(F.try_element_at(config, F.lit("dewarp_strength")).try_cast("double"), F.lit(0.0))
    known = [F.lit(x) for pair in OLDER_SETTINGS.items() for x in pair]
    older = F.create_map(*known, F.lit("dewarp_mode"), F.when(strength > 0, "manual").otherwise("off"))
    filled = F.map_concat(config, F.map_filter(older, lambda k, _: ~F.array_contains(F.map_keys(config), k)))
    wrong = F.raise_error(F.concat(F.lit("unknown manifest version "), version.cast("string"))).cast("int")
    return manifests.withColumns(
        {
            "spreads": spreads,
            "pages": fixed,
            "config": F.when(version < NEWEST, filled).otherwise(config),
            "version": F.when(version.between(OLDEST, NEWEST), F.lit(NEWEST)).otherwise(wrong),
        }
    )


def write_manifests(manifests: DataFrame, path: str) -> None:
    """Manifests of the newest version as JSON, in one folder a project below ``path``.

    Projects that ``manifests`` has not stay as they are. Files are written
    aside and put in place when all are whole, so a write that fails changes
    nothing. Any name reads back as it was.
    """
    migrate(manifests).write.partitionBy("project").option("partitionOverwriteMode", "dynamic").mode("overwrite").json(path)


def create_project(manifests: DataFrame, path: str) -> None:
    """Write new projects below ``path``; one that is there already is an error, and then none is written."""
    spark = manifests.sparkSession
    names = [r[0] for r in manifests.select("project").distinct().collect()]
    if None in names or "" in names:
        raise ValueError("a project needs a name")
    there = sorted(n for n in names if _exists(spark, _folder(spark, path, n)))
    if there:
        raise FileExistsError(f"there already: {', '.join(there)}")
    write_manifests(manifests, path)


def _folder(spark: SparkSession, path: str, project: str) -> str:
    return f"{path.rstrip('/')}/project={spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(project)}"


def managed_exports(exports: DataFrame, suffix: str) -> DataFrame:
    """Rows of ``exports`` whose ``path`` is a file right in its project's folder ``output`` and ends in ``suffix``; only those may be replaced.

    Null, absolute and winding paths are somebody else's files.
    """
    parts = F.split(F.regexp_replace("path", "/+", "/"), "/")
    steps = F.filter(parts, lambda p: p != ".")
    plain = (F.size(steps) == 2) & (F.get(steps, 0) == "output") & ~F.get(steps, 1).isin("", "..")
    own = ~F.startswith(F.col("path"), F.lit("/")) & plain & F.endswith(F.lower(F.get(steps, 1)), F.lit(suffix.lower()))
    # A name that is only a suffix has none.
    return exports.where(F.coalesce(own & (F.length(F.get(steps, 1)) > len(suffix)), F.lit(False)))


def some_rows(rows: DataFrame, message: str) -> DataFrame:
    """``rows``, of which there must be some."""
    if rows.isEmpty():
        raise ValueError(message)
    return rows


def page_count(value: Column, most: int = 10_000) -> Column:
    """A struct of the ``number`` of pages that a text asks for, null for none, and the ``problem`` if it can't be had."""
    text = F.trim(value)
    digits = F.rlike(text, F.lit(r"^\+?(0|[1-9][0-9]*)$"))
    number = F.when(digits, F.regexp_replace(text, r"^\+", "").try_cast("long"))
    inside = F.coalesce(number.between(1, most), F.lit(False))
    wrong = F.when(text.isNull() | (value == ""), F.lit(None)).when(~digits, "expected_page_count must be a positive integer").when(~inside, f"expected_page_count must be 1..{most}")
    return F.struct(F.when(inside, number.cast("int")).alias("number"), wrong.alias("problem"))


#: What may be said of a book, and how long it may be.
BOOK_FIELDS = {"title": 200, "author": 200, "series": 200, "volume": 64, "publisher": 200, "language": 32}


def book_metadata(given: Column) -> Column:
    """A struct of the ``fields`` of a book that a map of texts gives, and the first ``problem``; then it has no fields.

    White space is joined to single spaces; fields that are null or empty are
    left out, as a null map is.
    """
    known = F.array(*map(F.lit, BOOK_FIELDS))
    flat = F.transform_values(F.coalesce(given, F.create_map().cast("map<string,string>")), lambda _, v: F.trim(F.regexp_replace(v, r"\s+", " ")))
    fields = F.map_filter(flat, lambda _, v: v.isNotNull() & (v != ""))
    unknown = F.array_sort(F.array_except(F.map_keys(flat), known))
    value = lambda name: F.try_element_at(fields, F.lit(name))
    checks = [F.when(F.size(unknown) > 0, F.concat(F.lit("unknown book fields: "), F.array_join(unknown, ", ")))]
    for name, most in BOOK_FIELDS.items():
        checks.append(F.when(F.rlike(value(name), F.lit(r"[\x00-\x1F]")), f"book field {name} has control characters"))
        checks.append(F.when(F.length(value(name)) > most, f"book field {name} is too long"))
    problem = F.coalesce(*checks)
    return F.struct(F.when(problem.isNull(), fields).alias("fields"), problem.alias("problem"))


def updated(old: Column, new: Column, problem: Column) -> Column:
    """What becomes of an update: ``rejected``, ``unchanged`` or ``applied``."""
    return F.when(problem.isNotNull(), "rejected").when(old.eqNullSafe(new), "unchanged").otherwise("applied")


def remove_project(spark: SparkSession, path: str, project: str) -> bool:
    """Remove one project's folder below ``path``; whether there was one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark, path, project))
    return bool(folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True))


def catalog_of(manifests: DataFrame) -> DataFrame:
    """``project, source_name, status, n_pages`` of each manifest; several sources are named by the first and how many follow."""
    name = lambda path: F.element_at(F.split(path, "/"), -1)
    n, several = F.size("pages"), F.coalesce(F.size("sources"), F.lit(0))
    first = name(F.coalesce(F.try_element_at("sources", F.lit(1)), F.col("source")))
    more = F.when(several > 1, F.format_string(" +%d", several - 1)).otherwise("")
    shown = F.when(F.col("source_type") == "image_folder", F.format_string("%s (%d枚)", name(F.col("source")), n)).otherwise(F.concat(first, more))
    return manifests.select("project", shown.alias("source_name"), "status", n.alias("n_pages"))


def interval_records(spark: SparkSession, path: str) -> DataFrame:
    """Stable intervals of a checkpoint, a JSON list of ``start, end``; anything else fails."""
    return spark.read.schema("start double, end double").option("mode", "FAILFAST").json(path, multiLine=True)


def video_paths(paths: DataFrame, column: str = "path") -> DataFrame:
    """Rows whose path has the suffix of a source that can be read."""
    # Suffixes.
    return paths.where(F.lower(F.regexp_extract(F.col(column), r"\.[^./]*$", 0)).isin(".mov", ".mp4", ".ffconcat"))


def pages_of(manifests: DataFrame) -> DataFrame:
    """Output pages in their order."""
    return manifests.select("project", F.posexplode("pages").alias("position", "page")).select("project", "position", "page.*")


def candidates_of(manifests: DataFrame) -> DataFrame:
    rows = manifests.select("project", F.explode("spreads").alias("s")).select("project", F.col("s.id").alias("spread"), F.explode("s.candidates").alias("c"))
    return rows.select("project", "spread", F.col("c.id").alias("cand"), "c.time", "c.metrics.*", "c.suspect")


def image_files(spark: SparkSession, folder: str, most: int = 5000, suffixes: str = "*.{png,jpg,jpeg,webp,PNG,JPG,JPEG,WEBP}") -> DataFrame:
    """Images directly in a folder in natural order; more than ``most`` is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffixes).option("recursiveFileLookup", "false").load(folder)
    named = files.select("path", "length", F.element_at(F.split("path", "/"), -1).alias("name"))
    found = named.limit(most + 1).count()
    if found > most:
        raise ValueError(f"{folder} holds more than {most} images")
    # At most ``most`` names are numbered in one task.
    order = W.orderBy(natural_key(F.col("name")), "name")
    return named.withColumn("position", F.row_number().over(order) - 1)


def find_by_digest(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """Files whose SHA-256 is in ``wanted`` (id, sha256), whatever their names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256")).join(wanted, "sha256")


def write_score_rows(rows: DataFrame, path: str) -> None:
    """A table with its header; no rows leave what is there as it is."""
    if not rows.isEmpty():
        rows.write.mode("overwrite").csv(path, header=True)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where))


def read_score_rows(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; a missing table has no rows and no columns."""
    return spark.read.csv(path, header=True) if _exists(spark, path) else spark.createDataFrame([], T.StructType([]))


def write_trace(states: DataFrame, path: str) -> None:
    """Index, time, motion, sharpness and state of every sample."""
    states.select(F.col("idx").alias("index"), F.col("t").alias("time"), "motion", "sharpness", "state").write.mode("overwrite").csv(path, header=True)


def comic_info(metadata: dict[str, str], page_count: int) -> str:
    tags = {"title": "Title", "author": "Writer", "publisher": "Publisher", "series": "Series", "number": "Number", "language": "LanguageISO"}
    body = "".join(f"<{tag}>{escape(str(metadata[key]))}</{tag}>" for key, tag in tags.items() if metadata.get(key))
    return f'<?xml version="1.0" encoding="utf-8"?><ComicInfo>{body}<PageCount>{page_count}</PageCount></ComicInfo>'


def page_archives(pages: DataFrame, metadata: dict[str, str] | None = None) -> DataFrame:
    """One archive per project from ``project, position, suffix, content``: ``project, n_pages, archive``.

    Members are stored verbatim, named by their place with three digits or
    more. A project's pages are one book, which its archive holds in memory.
    """

    def pack(key, group):
        import pandas as pd

        group = group.sort_values("position")
        digits = max(3, len(str(len(group))))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
            for i, (suffix, content) in enumerate(zip(group["suffix"], group["content"], strict=True), 1):
                archive.writestr(zipfile.ZipInfo(f"{i:0{digits}d}{suffix}"), content)
            if metadata:
                archive.writestr(zipfile.ZipInfo("ComicInfo.xml"), comic_info(metadata, len(group)))
        return pd.DataFrame({"project": [key[0]], "n_pages": [len(group)], "archive": [out.getvalue()]})

    return pages.groupBy("project").applyInPandas(pack, "project string, n_pages long, archive binary")
