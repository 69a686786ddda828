"""Reports: front matter, sections, prompts, and the merging of parts, as string columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.ingestion import ordered


def quoted(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\"), F.lit("/")), F.lit('"'), F.lit("'"))


def front_matter(source: Column, title: Column, status: str = "gap_identified", labels: Column | None = None, references: Column | None = None) -> Column:
    """A header between lines of dashes; up to 50 labels and 40 references are listed."""
    listed = lambda name, xs, most: F.when(F.size(xs) > 0, F.concat(F.lit(f"{name}:\n"), F.array_join(F.transform(F.slice(xs, 1, most), lambda x: F.concat(F.lit('  - "'), quoted(x), F.lit('"'))), "\n")))
    parts = [F.lit("---"), F.lit("category: SPEC"), F.concat(F.lit("source_file: "), quoted(source)), F.lit(f"status: {status}"), F.concat(F.lit('title: "'), quoted(title), F.lit('"'))]
    if labels is not None:
        parts += [F.concat(F.lit("chunking_total: "), F.size(labels).cast("string")), F.concat(F.lit("chunking_mode: "), F.when(F.size(labels) > 1, "chunked").otherwise("single_part")), listed("chunking_labels", labels, 50)]
    if references is not None:
        parts.append(listed("sot_reference", references, 40))
    return F.concat(F.concat_ws("\n", *parts, F.lit("---")), F.lit("\n"))


def with_front_matter(body: Column, header: Column) -> Column:
    bare = F.regexp_replace(body, r"^\s+", "")
    return F.when(bare.startswith("---"), body).otherwise(F.concat(header, bare))


def merged_parts(chunks: DataFrame, key: str, order: str, label: str, body: str) -> DataFrame:
    """One report for each key: a head with the first eight labels, then the parts in order."""
    lists = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), F.col(label).alias("label"), F.col(body).alias("body")))).alias("xs"))
    labels = F.concat(F.array_join(F.transform(F.slice("xs", 1, 8), lambda x: x["label"]), ", "), F.when(F.size("xs") > 8, "…").otherwise(""))
    head = F.concat(F.lit("# Gap analysis — `"), F.col(key).cast("string"), F.lit("`\n\n_Analisi pipeline: **"), F.size("xs").cast("string"), F.lit("** parte/i ("), labels, F.lit(")._\n"))
    parts = F.array_join(F.transform("xs", lambda x: F.concat(F.lit("\n## Chunk: "), x["label"], F.lit("\n\n"), F.trim(x["body"]), F.lit("\n"))), "\n")
    return lists.select(key, F.size("xs").alias("n_parts"), F.concat(head, F.lit("\n"), parts).alias("report"))


def prompt(name: Column, context: Column, body: Column) -> Column:
    return F.concat(F.lit("## File\n"), name, F.lit("\n\n## Context\n"), context, F.lit("\n\n## Text\n"), body)


def gap_prompt(canon: Column, rag: Column, name: Column, part: Column, parts: Column, label: Column, body: Column) -> Column:
    """What a gap call asks: the canon, retrieved context if there is any, the file, which part of it this is, and the part.

    Its wording is fixed: replies are written for it."""
    found = F.when(F.trim(F.coalesce(rag, F.lit(""))) != "", F.concat(F.lit("\n\n"), rag, F.lit("\n"))).otherwise("")
    scope = F.concat(F.lit("\n> **Ambito (chunking):** Parte **"), part.cast("string"), F.lit("/"), parts.cast("string"), F.lit("** del file (`"), label, F.lit("`). Analizza **solo** il testo sotto; altre parti = altre passate LLM.\n"))
    end = F.lit("\n\n---\n\nReport **ricco e contestualizzato** per allegarlo a Claude/GPT e aggiornare LAST DOCS.\nRispetta la struttura del system prompt (Sintesi, GAP numerati, Azioni redazione, Handoff IA).")
    return F.concat(F.lit("# Documentazione SOT (Source of Truth)\n\n"), canon, F.lit("\n"), found, F.lit("\n---\n\n# Documento grezzo da confrontare\n\n**File:** `"), name, F.lit("`\n"), scope, F.lit("\n"), body, end)


def source_document(rel: Column, kind: Column, body: Column, pipeline: str = "documents") -> Column:
    """A source's text under a header with its path, type and pipeline, or a note in place of an empty one."""
    path = F.replace(rel, F.lit("\\"), F.lit("/"))
    text = F.coalesce(F.nullif(body, F.lit("")), F.lit("_Nessun testo estratto._"))
    head = F.concat(F.lit('---\nsource_file: "'), path, F.lit('"\nsource_ext: "'), F.lower(kind), F.lit(f'"\npipeline: {pipeline}\n---\n\n'))
    return F.concat(head, F.lit("# Sorgente: "), F.element_at(F.split(path, "/"), -1), F.lit("\n\n"), text, F.lit("\n"))


def report_entry(rel: Column, body: Column) -> Column:
    """One file's section of the general report, without the time of its writing."""
    return F.concat(F.lit("\n\n---\n\n## File grezzo: `"), rel, F.lit("`\n\n"), _bare(body), F.lit("\n"))


def general_report(entries: DataFrame, header: Column, order: str, key: str | None = None) -> DataFrame:
    """place and text of the lines of a growing report: the header as place 0, then the entries in their order.

    The report stays rows, one for each section, so that it grows by appending and no task holds all of it: without a key
    places are given by ranges of the order.
    """
    keys = [key] if key else []
    numbered = entries.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order))) if keys else ordered(entries, [order], "place")
    rows = numbered.select(*keys, "place", "text")
    first = entries.select(*keys).distinct() if keys else entries.sparkSession.range(1)
    return rows.unionByName(first.select(*keys, F.lit(0).alias("place"), header.alias("text")))


def only_new(reports: DataFrame, written: DataFrame, key: str, replace: bool = False) -> DataFrame:
    """The reports to be written: all if those there are to be replaced, else those whose key isn't there yet."""
    return reports if replace else reports.join(written.select(key).distinct(), key, "left_anti")


def workflow_body(content: Column, workflow: Column, source: Column, header: Column | None = None) -> Column:
    """An output's text under its header, or under the workflow's name and source."""
    body = _bare(F.coalesce(content, F.lit("")))
    named = F.concat(F.lit("# "), F.initcap(F.replace(workflow, F.lit("_"), F.lit(" "))), F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.lit("\n\n- **Sorgente:** `"), source, F.lit("`"))).otherwise(""))
    head = named if header is None else F.coalesce(_bare(header), named)
    return F.concat(head, F.when(body == "", "\n").otherwise(F.concat(F.lit("\n\n"), body)))


def joined_parts(rel: Column, parts: Column) -> Column:
    """Numbered parts of one source under its name."""
    each = F.transform(parts, lambda p, i: F.concat(F.lit("## Parte "), (i + 1).cast("string"), F.lit("\n\n"), p))
    return F.concat(F.lit("# Estrazione multi-parte: "), rel, F.lit("\n\n"), F.array_join(each, "\n\n---\n\n"))


def newest(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The newest rows of a log that keeps at most so many."""
    return rows.orderBy(*order).limit(most)


def consolidation_prompt(rel: Column, report: Column, references: Column, parts: Column, most: int = 12_000) -> Column:
    """What asks for one report in place of the reports on several parts; null where there is only one, which stays."""
    listed = F.array_join(F.transform(F.slice(references, 1, 30), lambda r: F.concat(F.lit("- "), r)), "\n")
    text = F.concat(
        F.lit("# File grezzo\n`"), rel, F.lit("` — analizzato in **"), parts.cast("string"), F.lit("** parti (chunk).\n\n# Riferimenti SOT consultati\n"), listed,
        F.lit("\n\n---\n\n# Report per chunk (da consolidare senza perdere contesto)\n\n"), F.substring(report, 1, most), F.lit("\n\n---\n\nProduci il report consolidato unico, ricco, pronto per handoff a Claude/GPT."),
    )
    return F.when((parts > 1) & (F.trim(report) != ""), text)


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")
