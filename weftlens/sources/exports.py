"""Result sinks: TSV and CSV with a comment header, JSON, XML; dictionaries and manifests.

Rows are made and sorted by Spark. A single file is put together by copying the part files' bytes between a head and a foot."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .scratch import remove, shared_dir

#: The titles of the table, the lines of its header, the names and markup of the XML layout.
COLUMNS = ["Result", "Target_Loc", "Target_Txt", "Source_Loc", "Source_Txt", "Shared", "Score", "Raw_Score"]
HEADER = ("session", "source", "target", "unit", "feature", "stopsize", "stbasis", "stopwords", "max_dist", "dibasis", "cutoff", "filter")
HEADER_CROSS = ("session", "source", "target", "unit", "stopsize", "stbasis", "greek_stopwords", "latin_stopwords", "max_dist", "dibasis", "cutoff", "filter")
SPAN = ('<span class="matched">', "</span>")
FORMATS = {"csv": ",", "tsv": "\t", "json": None, "xml": None}


def highlighted(markup: tuple[str, str] = ("**", "**")) -> dict[str, Column]:
    """source_snippet and target_snippet with the words of `highlight` (s_pos, t_pos) marked."""
    return {f"{side}_snippet": X.highlight(F.col(f"{side}_snippet"), F.col(f"highlight.{p}"), *markup) for side, p in (("source", "s_pos"), ("target", "t_pos"))}


def export_rows(ranked: DataFrame) -> DataFrame:
    """ranked(result, target_tag, target_snippet, source_tag, source_snippet, features, normal_score, score) to COLUMNS."""
    return ranked.select(
        F.col("result").alias("Result"), F.col("target_tag").alias("Target_Loc"), F.col("target_snippet").alias("Target_Txt"), F.col("source_tag").alias("Source_Loc"),
        F.col("source_snippet").alias("Source_Txt"), F.array_join("features", "; ").alias("Shared"), F.round("normal_score", 3).alias("Score"), F.round("score", 6).alias("Raw_Score"))


def header(parameters: dict) -> list[str]:
    """Comment lines; which names they have depends on the method."""
    names = HEADER_CROSS if parameters.get("method") == "greek_to_latin" else HEADER
    width = max(map(len, names))
    shown = lambda v: " ".join(map(str, v)) if isinstance(v, (list, tuple)) else v
    return ["# Results", "#", *(f"# {k:<{width}} = {shown(parameters.get(k, ''))}" for k in names)]


def header_parameters(search: dict, source: dict, target: dict) -> dict:
    """What the header shows of a search's parameters and its two texts."""
    p = search["parameters"]
    stop = p["stopwords"] if isinstance(p["stopwords"], list) else []
    name = lambda t: f"{t['author']}.{t['title'].lower().replace(' ', '_')}"
    return {"session": search["results_id"], "source": name(source), "target": name(target), "unit": p["unit_type"], "feature": p["feature"], "method": p["method"],
            "stopsize": len(stop) if stop else p["stopwords"], "stbasis": p["stopword_basis"], "stopwords": stop, "greek_stopwords": p.get("far_stopwords") or stop, "latin_stopwords": stop,
            "max_dist": p["max_distance"], "dibasis": p["distance"], "cutoff": p["min_score"], "filter": "off"}


def assembled(lines: DataFrame, path: str, head: str = "", foot: str = "", gzip: bool = False) -> None:
    """One file of the only column of lines, in their order, between head and foot."""
    spark = lines.sparkSession
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/x-{uuid.uuid4().hex}"
    lines.write.text(folder)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    file = jvm.org.apache.hadoop.fs.Path
    fs_in, fs_out = file(folder).getFileSystem(conf), file(path).getFileSystem(conf)
    out = fs_out.create(file(path), True)
    out = jvm.java.util.zip.GZIPOutputStream(out) if gzip else out
    try:
        out.write(bytearray(head.encode()))
        for part in sorted(s.getPath().toString() for s in fs_in.listStatus(file(folder)) if s.getPath().getName().startswith("part-")):
            with_ = fs_in.open(file(part))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(with_, out, 1 << 16, False)
            with_.close()
        out.write(bytearray(foot.encode()))
    finally:
        out.close()
        remove(spark, folder)


def delimited(rows: DataFrame, delimiter: str) -> DataFrame:
    """COLUMNS as lines; texts in quotes, quotes in them doubled."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    text = {"Target_Loc", "Target_Txt", "Source_Loc", "Source_Txt", "Shared"}
    return rows.orderBy("Result").select(F.concat_ws(delimiter, *[quoted(c) if c in text else F.col(c).cast("string") for c in COLUMNS]).alias("value"))


def write_delimited(matches: DataFrame, path: str, parameters: dict, delimiter: str = "\t", gzip: bool = True) -> None:
    """Ranked matches with snippets and highlights as one file: comments, titles, rows by rank."""
    rows = export_rows(matches.withColumns(highlighted()))
    head = "\n".join([*header(parameters), delimiter.join(COLUMNS)]) + "\n"
    assembled(delimited(rows, delimiter), path, head, gzip=gzip)


def json_lines(matches: DataFrame) -> DataFrame:
    """The result objects, each but the first led by a comma."""
    m = matches.withColumns(highlighted())
    row = F.to_json(F.struct(
        F.col("match_id").alias("result_id"), "source_unit", "target_unit", "source_tag", "target_tag", F.col("features").alias("matched_features"), "source_snippet", "target_snippet",
        F.col("normal_score").alias("score"), F.col("score").alias("raw_score")))
    return m.withColumn("_row", F.concat(F.when(F.col("result") > 1, ",").otherwise(""), row)).orderBy("result").select(F.col("_row").alias("value"))


def write_json(matches: DataFrame, path: str, search: dict, source: dict, target: dict) -> None:
    """One object: the search with its parameters, the two texts merged into them, and the results."""
    out = {k: v for k, v in search.items() if k not in ("results_id", "progress", "status", "msg")}
    out["parameters"] = {**search["parameters"], "source": {"object_id": source["text_id"], **source}, "target": {"object_id": target["text_id"], **target}}
    assembled(json_lines(matches), path, json.dumps(out, ensure_ascii=False, default=str)[:-1] + ', "results": [\n', "]}\n")


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def xml_lines(matches: DataFrame) -> DataFrame:
    """The result elements."""
    number = lambda c: F.format_string("%s", F.col(c))

    def phrase(side: str, p: str) -> Column:
        words = F.split(F.col(f"{side}_tag"), " ")
        work = F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")
        text = X.highlight(_escaped(F.col(f"{side}_snippet")), F.col(f"highlight.{p}"), *SPAN)
        return F.concat(F.lit(f'<phrase text="{side}" work="'), _escaped(work), F.lit('" unitId="'), F.col(f"{side}_unit").cast("string"), F.lit('" line="'), _escaped(F.element_at(words, -1)), F.lit('">'), text, F.lit("</phrase>"))

    row = F.concat(F.lit('<tessdata keywords="'), _escaped(F.array_join("features", ", ")), F.lit('" score="'), number("normal_score"), F.lit('" raw_score="'), number("score"), F.lit('">'),
                   phrase("source", "s_pos"), phrase("target", "t_pos"), F.lit("</tessdata>"))
    return matches.withColumn("_row", row).orderBy("result").select(F.col("_row").alias("value"))


def write_xml(matches: DataFrame, path: str, parameters: dict) -> None:
    """The search's parameters as attributes of the root, the stopwords, and an element for each result."""
    from xml.sax.saxutils import escape, quoteattr

    shown = {"source": parameters["source"].lower(), "target": parameters["target"].lower(), "unit": parameters["unit"].lower(), "feature": parameters["feature"].lower(), "sessionID": parameters["session"],
             "stop": parameters["stopsize"], "stbasis": parameters["stbasis"], "max_dist": parameters["max_dist"], "dibasis": parameters["dibasis"], "cutoff": parameters["cutoff"]}
    head = "<results " + " ".join(f"{k}={quoteattr(str(v))}" for k, v in shown.items()) + f">\n<comment>Results</comment>\n<commonwords>{escape(', '.join(parameters['stopwords']))}</commonwords>\n"
    assembled(xml_lines(matches), path, head, "</results>\n")


def export(matches: DataFrame, path: str, file_format: str, search: dict, source: dict, target: dict, delimiter: str | None = None) -> None:
    """Write a finished search's ranked matches. RuntimeError if it isn't Done, ValueError for an unknown format or a missing text."""
    if file_format not in FORMATS:
        raise ValueError(f"unknown format {file_format!r}")
    if not search or not source or not target:
        raise ValueError("the search or one of its texts is missing")
    if search["status"] != "Done":
        raise RuntimeError(f"the search is {search['status']}")
    p = header_parameters(search, source, target)
    if file_format == "json":
        write_json(matches, path, search, source, target)
    elif file_format == "xml":
        write_xml(matches, path, p)
    else:
        write_delimited(matches, path, p, delimiter or FORMATS[file_format], gzip=path.endswith(".gz"))


def read_dictionary(spark: SparkSession, path: str, language: str, key: str = "feature", value: str = "other", value_language: str | None = None) -> DataFrame:
    """Edges of a CSV: the language's normal form of a line's first field, to those of the others. Lines with less than two forms
    are skipped, of equal keys the last line counts."""
    @F.pandas_udf("array<string>")
    def forms(lines: pd.Series) -> pd.Series:
        from ..operators.tokenizers import tokenizer

        first, rest = tokenizer(language), tokenizer(value_language or language)

        def one(line: str) -> list[str]:
            head, _, tail = line.partition(",")
            return [*first.normalize(head)[0][:1], *rest.normalize(tail.replace(",", " "))[0]] if first.normalize(head)[0] else []

        return lines.map(one)

    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("no", "line"))
    rows = lines.select("no", forms("line").alias("p")).filter(F.size("p") >= 2)
    last = rows.groupBy(F.get("p", F.lit(0)).alias(key)).agg(F.max_by("p", "no").alias("p"))
    return last.select(key, F.explode(F.array_distinct(F.slice("p", 2, F.size("p") - 1))).alias(value))


MANIFEST = "title string, author string, language string, year int, path string, is_prose boolean"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of texts to ingest."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """A TSV of texts to ingest again: (author, title)."""
    return spark.read.schema("author string, title string").csv(path, sep="\t")


def read_updates(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of objects with `_id` and the fields to change."""
    return spark.read.json(path, multiLine=True).withColumnRenamed("_id", "text_id")
