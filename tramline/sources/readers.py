"""Readers and writers: BPMN, texts, ground truths, dictionaries; one row per case, parsed in parallel."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import base_name

_PART = "kind string, case_id string, process_id string, id string, tag string, type string, name string, src string, dst string, seq int"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def element_type(tag: str) -> str | None:
    """task and *Task -> Task, *Event -> Event, *Gateway -> Gateway; all else (sub-processes, call activities) is no element."""
    m = re.search(r"(?:^t|T)ask$|Event$|Gateway$", tag)
    return m[0].capitalize() if m else None


def parse_bpmn(case: str, xml: str) -> list[tuple]:
    """Rows of all kinds: element, edge, lane, member, pool, message_flow. Only what lies directly under a process counts."""
    rows: list[tuple] = []
    root = ET.fromstring(xml)
    for process in (p for p in root.iter() if _local(p.tag) == "process"):
        pid = process.get("id")
        for x in process:
            tag, type_ = _local(x.tag), element_type(_local(x.tag))
            if type_:
                rows.append(("element", case, pid, x.get("id"), tag, type_, x.get("name"), None, None, len(rows)))
            elif tag == "sequenceFlow":
                rows.append(("edge", case, pid, x.get("id"), tag, "Flow", x.get("name"), x.get("sourceRef"), x.get("targetRef"), len(rows)))
        for lane in (x for x in process.iter() if _local(x.tag) == "lane"):
            rows.append(("lane", case, pid, lane.get("id"), "lane", "Lane", lane.get("name"), None, None, len(rows)))
            rows += [("member", case, pid, lane.get("id"), "lane", "Lane", None, None, (r.text or "").strip(), len(rows)) for r in lane if _local(r.tag) == "flowNodeRef"]
    for x in root.iter():
        if _local(x.tag) == "participant":
            rows.append(("pool", case, x.get("processRef"), x.get("id"), "participant", "Pool", x.get("name"), None, None, len(rows)))
        elif _local(x.tag) == "messageFlow":
            rows.append(("message_flow", case, None, x.get("id"), "messageFlow", "MessageFlow", x.get("name"), x.get("sourceRef"), x.get("targetRef"), len(rows)))
    return rows


def bpmn_parts(models: DataFrame) -> DataFrame:
    """models(case_id, xml) -> one table of parts, parsed where the files lie. Broken XML gives a row of kind "error"."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for case, xml in zip(pdf["case_id"], pdf["xml"]):
                try:
                    rows += parse_bpmn(case, xml)
                except (ET.ParseError, TypeError) as e:
                    rows.append(("error", case, None, None, None, None, str(e), None, None, 0))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PART.split(", ")])

    return models.select("case_id", "xml").mapInPandas(run, _PART)


def bpmn_tables(parts: DataFrame) -> dict[str, DataFrame]:
    """elements, edges, lanes, members, pools and message_flows from the parts."""

    def of(kind: str, **columns: str) -> DataFrame:
        return parts.filter(F.col("kind") == kind).select("case_id", *[F.col(v).alias(k) for k, v in columns.items()])

    return {
        "elements": of("element", process_id="process_id", elem_id="id", elem_type="type", tag="tag", name="name"),
        "edges": of("edge", process_id="process_id", flow_id="id", src="src", dst="dst", name="name"),
        "lanes": of("lane", process_id="process_id", lane_id="id", name="name"),
        "members": of("member", lane_id="id", elem_id="dst"),
        "pools": of("pool", pool_id="id", name="name", process_id="process_id"),
        "message_flows": of("message_flow", seq="seq", src="src", dst="dst"),
    }


def read_files(spark: SparkSession, path: str, extension: str, column: str) -> DataFrame:
    """All files of an extension under a path -> (case_id, column): the name without folder and extension, the whole text."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*.{extension}")
    return files.select(base_name(F.col("_metadata.file_name")).alias("case_id"), F.col("value").alias(column))


def read_models(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, "bpmn", "xml")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, "txt", "text")


def ground_truth(files: DataFrame) -> DataFrame:
    """files(case_id, json) -> (case_id, elem_id, sent_id int from 0, err): one row per element; null errors are none."""
    parsed = files.select("case_id", F.from_json("json", "alignment map<string,string>, errors map<string,string>").alias("g"))
    rows = parsed.select("case_id", F.explode("g.alignment").alias("elem_id", "_value"), F.col("g.errors").alias("_errors"))
    err = F.coalesce(F.try_element_at("_errors", F.col("elem_id")), F.when(F.col("_value") == "no-match", "m"))
    return rows.select("case_id", "elem_id", F.expr("try_cast(_value as int)").alias("sent_id"), err.alias("err"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return ground_truth(read_files(spark, path, "json", "json"))


def complete_cases(models: DataFrame, texts: DataFrame, truths: DataFrame) -> DataFrame:
    """Cases that have all three, by name."""
    return models.select("case_id").join(texts.select("case_id"), "case_id").join(truths.select("case_id").distinct(), "case_id")


#: Columns of a legacy file that are read; the fifth has no meaning.
_LEGACY = ("task_id", "task", "sent", "err", "unused", "said_id", "said")


def _legacy_cells(lines: DataFrame) -> DataFrame:
    """lines(case_id, no, line) -> cells, trimmed, quotes read as in CSV, with the marks that part a file's blocks.

    _table: after the first line and before the first empty one; _tasks and _said: how many lines of the table so far have no
    task id and no sentence id; _text: how many lines so far are the headline `Original text`. Marks are running counts over
    the lines of a case in one order, so that a file is read in one sorted pass.
    """
    options = {"sep": ";", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    cells = F.from_csv(F.coalesce("line", F.lit("")), ", ".join(f"{c} string" for c in _LEGACY), options)
    named = lines.withColumn("_c", cells).select("case_id", "no", "line", *[F.coalesce(F.trim(F.col("_c")[c]), F.lit("")).alias(c) for c in _LEGACY])
    order = Window.partitionBy("case_id").orderBy("no")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    empty = F.regexp_replace(F.coalesce("line", F.lit("")), "[;\\s]", "") == ""
    blocks = named.withColumn("_table", (F.row_number().over(order) > 1) & (F.count_if(empty).over(so_far) == 0))
    return blocks.select(
        "*", F.count_if(F.col("_table") & (F.col("task_id") == "")).over(so_far).alias("_tasks"), F.count_if(F.col("_table") & (F.col("said_id") == "")).over(so_far).alias("_said"),
        F.count_if(F.col("task_id") == "Original text").over(so_far).alias("_text"),
    )


def legacy_ground_truth(lines: DataFrame) -> DataFrame:
    """lines(case_id, line no, line): `;`-separated task id, task, sentence id, error -> (case_id, task_id, task, sent_id, err).

    The table has a headline and ends at the first empty line, its tasks at the first line without a task id. A sentence id
    that is no number means no match (null). A task id that is no number leaves its line out.
    """
    rows = _legacy_cells(lines).filter("_table and _tasks = 0")
    number = lambda c: F.expr(f"try_cast({c} as int)")
    return rows.select("case_id", number("task_id").alias("task_id"), "task", number("sent").alias("sent_id"), F.nullif("err", F.lit("")).alias("err")).filter("task_id is not null")


def legacy_sentences(lines: DataFrame) -> DataFrame:
    """The same lines -> (case_id, sent_id, said, sentence): sentences by the sixth and seventh cell, up to the first line without
    a sentence id; the original of the k-th is the k-th line below the headline `Original text`, null where there are fewer."""
    cells = _legacy_cells(lines)
    nth = F.row_number().over(Window.partitionBy("case_id").orderBy("no"))
    said = cells.filter("_table and _said = 0").select("case_id", "said_id", "said", nth.alias("_k"))
    text = cells.filter("_text > 0").select("case_id", F.col("task_id").alias("sentence"), (nth - 1).alias("_k"))
    rows = said.join(text, ["case_id", "_k"], "left")
    return rows.select("case_id", F.expr("try_cast(said_id as int)").alias("sent_id"), "said", "sentence").filter("sent_id is not null")


def hypernyms(lines: DataFrame) -> DataFrame:
    """lines(value): "child parent[:parent...]", "-" for none -> (child, parent)."""
    parts = F.split("value", " ")
    return lines.select(F.get(parts, F.lit(0)).alias("child"), F.explode(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("-")), ":")).alias("parent")).filter("parent <> '-'")


def senses(lines: DataFrame) -> DataFrame:
    """lines(value): "synset sense..." -> (wn, senses array)."""
    parts = F.split("value", " ")
    return lines.select(F.get(parts, F.lit(0)).alias("wn"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("senses"))


def write_table(df: DataFrame, path: str, format: str = "parquet", by: str | None = None) -> None:
    writer = df.write.mode("overwrite").format(format)
    (writer.partitionBy(by) if by else writer).save(path)


#: Stencil names of the JSON process format by BPMN tag.
STENCILS = {"Task": "task", "StartNoneEvent": "startEvent", "StartMessageEvent": "startEvent", "EndNoneEvent": "endEvent", "EndMessageEvent": "endEvent", "IntermediateMessageEventCatching": "intermediateCatchEvent", "IntermediateTimerEvent": "intermediateCatchEvent", "IntermediateMessageEventThrowing": "intermediateThrowEvent", "Exclusive_Databased_Gateway": "exclusiveGateway", "ParallelGateway": "parallelGateway", "InclusiveGateway": "inclusiveGateway", "EventbasedGateway": "eventBasedGateway"}


def parse_json_process(case: str, text: str) -> list[tuple]:
    """The same rows as parse_bpmn from nested shapes {resourceId, stencil.id, properties.name, outgoing, childShapes}."""
    import json

    shapes: list[tuple[dict, str | None, str | None]] = []

    def walk(shape: dict, pool: str | None, lane: str | None) -> None:
        kind = shape.get("stencil", {}).get("id")
        shapes.append((shape, pool, lane))
        for child in shape.get("childShapes", []):
            walk(child, shape["resourceId"] if kind == "Pool" else pool, shape["resourceId"] if kind == "Lane" else lane)

    for top in json.loads(text).get("childShapes", []):
        walk(top, None, None)
    after = {s["resourceId"]: [o["resourceId"] for o in s.get("outgoing", [])] for s, _, _ in shapes}
    before: dict[str, str] = {o: i for i, out in after.items() for o in out}
    rows: list[tuple] = []
    for s, pool, lane in shapes:
        kind, key, name = s.get("stencil", {}).get("id"), s["resourceId"], s.get("properties", {}).get("name")
        if kind in STENCILS:
            tag = STENCILS[kind]
            rows.append(("element", case, pool, key, tag, element_type(tag), name, None, None, len(rows)))
            if lane:
                rows.append(("member", case, pool, lane, "lane", "Lane", None, None, key, len(rows)))
        elif kind == "SequenceFlow" and after[key]:
            rows.append(("edge", case, pool, key, "sequenceFlow", "Flow", name, before.get(key), after[key][0], len(rows)))
        elif kind == "MessageFlow" and after[key]:
            rows.append(("message_flow", case, None, key, "messageFlow", "MessageFlow", name, before.get(key), after[key][0], len(rows)))
        elif kind == "Lane":
            rows.append(("lane", case, pool, key, "lane", "Lane", name, None, None, len(rows)))
        elif kind == "Pool":
            rows.append(("pool", case, key, key, "participant", "Pool", name, None, None, len(rows)))
    return rows


def json_process_parts(models: DataFrame) -> DataFrame:
    """models(case_id, json) -> parts, as bpmn_parts gives them; broken JSON gives a row of kind "error"."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for case, text in zip(pdf["case_id"], pdf["json"]):
                try:
                    rows += parse_json_process(case, text)
                except (ValueError, TypeError, KeyError, AttributeError) as e:
                    rows.append(("error", case, None, None, None, None, str(e), None, None, 0))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PART.split(", ")])

    return models.select("case_id", "json").mapInPandas(run, _PART)
