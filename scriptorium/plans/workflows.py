"""Workflows: transforms of DataFrames with an injected completion, which has a deterministic stand-in."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import budgets
from scriptorium.functions.text import language_of, missing_sections, parsed_reply, truncated_middle
from scriptorium.operators.dedup import saved
from scriptorium.operators.docmap import vision_prompts
from scriptorium.operators.ingestion import batch
from scriptorium.operators.layout import assembled, numbered_pages
from scriptorium.operators.overlap import markdown_chunks
from scriptorium.operators.reports import gap_prompt, merged_parts
from scriptorium.operators.retrieval import canon_bundle
from scriptorium.operators.semantic import raw_extract_chunks
from scriptorium.operators.state import RESUMABLE
from scriptorium.sources.files import code_lines

Complete = Callable[[str], str]
Step = Callable[[DataFrame], DataFrame]
CATALOG = ["ingest", "test_workflow", "blog_post", "code_analysis", "devblog", "doc_refactor", "flow", "gap_analysis", "reflect", "v2_ingest_beta"]


def stub(prompt: str) -> str:
    """Stands in for a model: the digest of the prompt."""
    return hashlib.sha256(prompt.encode()).hexdigest()


def completed(rows: DataFrame, prompt: str = "prompt", answer: str = "answer", complete: Complete | None = None, keep_error: str = "error") -> DataFrame:
    """Rows with the answer to their prompts; a failed call leaves answer null and says why in `error`; null isn't asked.

    Without a completion the stand-in answers, as a built-in expression.
    """
    if complete is None:
        return rows.withColumns({answer: F.sha2(F.col(prompt).cast("binary"), 256), keep_error: F.lit(None).cast("string")})
    names = [c for c in rows.columns if c not in (answer, keep_error)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers, errors = [], []
            for text in batch.column(prompt).to_pylist():
                try:
                    answers.append(None if text is None else complete(text)), errors.append(None)
                except Exception as e:  # noqa: BLE001  a failed call is a result here
                    answers.append(None), errors.append(str(e)[:500])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=[*names, answer, keep_error])

    return rows.select(*names).mapInArrow(run, T.StructType([*[rows.schema[c] for c in names], T.StructField(answer, T.StringType()), T.StructField(keep_error, T.StringType())]))


def flow(rows: DataFrame, steps: list[Step]) -> DataFrame:
    """Steps one after another."""
    for step in steps:
        rows = step(rows)
    return rows


def single_call(docs: DataFrame, most: int, task: str, complete: Complete | None = None) -> DataFrame:
    """doc_id and answer: a text cut to `most` code points in its middle, with the task before it."""
    prompts = docs.select("doc_id", F.concat(F.lit(task + "\n\n"), truncated_middle(F.coalesce("text", F.lit("")), most, "doc")).alias("prompt"))
    return completed(prompts, complete=complete).drop("prompt")


def tree_reduce(parts: DataFrame, key: str, order: str, body: str, size: int = 5, complete: Complete | None = None) -> DataFrame:
    """Two levels: answers over groups of `size` neighbours by their places, then one over the groups' answers of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    groups = parts.withColumn("part", F.floor(place / size).cast("int")).groupBy(key, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(body).alias("b")))), lambda p: p["b"]), "\n").alias("prompt"))
    partial = completed(groups, complete=complete).drop("error")
    finals = partial.groupBy(key).agg(F.count("*").alias("n_groups"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("part").alias("o"), F.col("answer").alias("b")))), lambda p: p["b"]), "\n").alias("prompt"))
    return completed(finals, complete=complete).drop("prompt")


def with_fallbacks(rows: DataFrame, models: list[str], complete: Callable[[str, str], str] | None = None, system: str = "", output: int = 4096) -> DataFrame:
    """Rows with an answer to `prompt` from the first model of a chain that gives one, and the model's name.

    Before each try a prompt that doesn't fit the model is cut; a fatal error ends the row's chain, any other lets the
    next model try with 0.7 of the output before. Answered rows aren't asked again.
    """
    left = rows.withColumns({"answer": F.lit(None).cast("string"), "model": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    for model in models:
        fit = budgets.request(F.lit(model), F.lit(system), F.col("prompt"), reserved=output)
        open_ = F.col("answer").isNull() & ((F.col("error").isNull()) | (budgets.error_class(F.coalesce("error", F.lit(""))) != "fatal"))
        cut = left.withColumn("prompt", F.when(open_, budgets.shrunk(F.col("prompt"), fit["fits"], fit["usable"], fit["projected"])).otherwise(F.col("prompt")))
        asked = completed(cut.withColumn("_ask", F.when(open_, F.col("prompt"))), "_ask", "_now", (lambda text, m=model: complete(m, text)) if complete else None, keep_error="_error")
        left = asked.withColumns({
            "model": F.when(open_ & F.col("_error").isNull(), F.lit(model)).otherwise(F.col("model")), "answer": F.coalesce("answer", F.when(open_, F.col("_now"))),
            "error": F.when(open_, F.col("_error")).otherwise(F.col("error"))}).drop("_ask", "_now", "_error")
        output = int(output * 0.7)
    return left


def sliding_context(chunks: DataFrame, key: str, order: str, condensed: str, most: int = 2) -> DataFrame:
    """Chunks with the condensates of the two before them as context, the older one first."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(-most, -1)
    return chunks.withColumn("context", F.array_join(F.collect_list(condensed).over(before), "\n\n"))


def remembered(chunks: DataFrame, key: str, order: str, text: str, extract: Callable[[str, str], dict] | None = None) -> DataFrame:
    """key, order, facts and history of each chunk: a document's chunks are read one after another, each with the history
    that the one before it left. A reply that can't be read adds the start of the text to the history, any other failure
    leaves it. A document's chunks come as sorted rows of one group, a batch of them at a time; only the history is kept.
    """
    kind, place = chunks.schema[key].dataType.simpleString(), chunks.schema[order].dataType.simpleString()
    names = [key, order]

    def one(body: str, history: str) -> tuple[list[str], str]:
        try:
            found = extract(body, history) if extract else {"facts": [stub(body)[:8]], "context": stub(history + body)}
            return [str(x) for x in found["facts"]], str(found["context"])
        except ValueError:
            return [], f"{history}\n\n{body[:500]}... [Compressione Fallita]"
        except Exception:  # noqa: BLE001  a failed call is a result here
            return [], history

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        history = ""
        for batch in batches:
            facts, after = [], []
            for body in batch.column(text).to_pylist():
                found, history = one(body or "", history)
                facts.append(found), after.append(history)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(facts, pa.list_(pa.string())), pa.array(after, pa.string())], names=[*names, "facts", "history"])

    def group(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(run(table.sort_by(order).to_batches())))

    return chunks.select(key, order, text).groupBy(key).applyInArrow(group, f"{key} {kind}, {order} {place}, facts array<string>, history string")


def refactored(chunks: DataFrame, key: str, order: str, text: str, most_tokens: int, complete: Complete | None = None) -> DataFrame:
    """key and answer: each chunk's reply is parsed, and all replies of a document are put together by one more call, or
    by groups first where they are longer than a prompt may be."""
    asked = completed(chunks.select(key, order, F.col(text).alias("prompt")), complete=complete)
    replies = asked.select(key, order, F.to_json(parsed_reply(F.coalesce("answer", F.lit("")), F.col(order).cast("int"))).alias("body"))
    sizes = replies.groupBy(key).agg(F.sum(F.length("body") + 1).alias("_chars"))
    both = replies.join(sizes, key)
    few, many = both.where(F.col("_chars") <= 4 * most_tokens), both.where(F.col("_chars") > 4 * most_tokens)
    small = few.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "body"))), lambda x: x["body"]), "\n").alias("prompt"))
    return completed(small, complete=complete).select(key, "answer").unionByName(tree_reduce(many, key, order, "body", complete=complete).select(key, "answer"))


def chained(docs: DataFrame, first: Step, second: Step) -> DataFrame:
    """The answers of one workflow as the texts of the next."""
    return second(first(docs).select("doc_id", F.col("answer").alias("text")))


def retried(rows: DataFrame, steps: list[Step], tries: int = 1, on_error: str = "stop") -> DataFrame:
    """Steps one after another over rows with answer and error: failed rows of a step are tried again, `tries` times; what
    still fails goes no further (stop) or goes on as it was (skip)."""
    done = None
    for step in steps:
        out = step(rows)
        for _ in range(tries):
            failed = out.where("error is not null")
            out = out.where("error is null").unionByName(step(rows.join(failed.select("doc_id"), "doc_id", "left_semi")))
        stopped = out.where("error is not null")
        done = stopped if done is None else done.unionByName(stopped, allowMissingColumns=True)
        good = out.where("error is null").select("doc_id", F.col("answer").alias("text"))
        rows = good if on_error == "stop" else good.unionByName(rows.join(stopped.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text"))
    return rows.withColumn("error", F.lit(None).cast("string")).unionByName(done.select("doc_id", F.lit(None).cast("string").alias("text"), "error")) if on_error == "stop" else rows.withColumn("error", F.lit(None).cast("string"))


def batch_status(results: DataFrame) -> DataFrame:
    """One row: n_ok, n_failed, and ok, partial (none worked) or skipped (there was nothing) for a run over many files."""
    return results.agg(F.count_if(F.col("error").isNull()).alias("n_ok"), F.count_if(F.col("error").isNotNull()).alias("n_failed")).withColumn("status", F.when(F.col("n_ok") + F.col("n_failed") == 0, "skipped").when(F.col("n_ok") > 0, "ok").otherwise("partial"))


#: Code points of a text that each of the single-call workflows takes, and the sections that an analysis needs.
MOST_CHARS = {"blog_post": 28_000, "code_analysis": 32_000, "reflect": 24_000}
SECTIONS = ["architettura", "vulnerabilit", "refactoring"]


def named_call(docs: DataFrame, workflow: str, complete: Complete | None = None) -> DataFrame:
    """doc_id and answer of one of the single-call workflows."""
    return single_call(docs, MOST_CHARS[workflow], workflow, complete)


def analysed_code(files: DataFrame, complete: Complete | None = None, sections: list[str] | None = None) -> DataFrame:
    """doc_id, language, lines, answer and missing sections of source files (doc_id, path, text); blank ones are errors."""
    known = files.select("doc_id", "text", language_of(F.col("path")).alias("language"), code_lines(F.col("text")).alias("lines"))
    answers = named_call(known.where("lines is not null").select("doc_id", "text"), "code_analysis", complete)
    found = known.select("doc_id", "language", "lines").join(answers, "doc_id", "left")
    empty = F.when(F.col("lines").isNull(), "empty file")
    return found.withColumns({"missing": missing_sections(F.coalesce("answer", F.lit("")), sections or SECTIONS), "error": F.coalesce("error", empty)})


def gap_report(docs: DataFrame, canon: DataFrame, max_tokens: int, complete: Complete | None = None, most_canon: int = 14_000, most_raw: int = 9_000, rag: DataFrame | None = None) -> DataFrame:
    """doc_id, n_parts and report of each document (doc_id, text) against the canon (tier, rel, text).

    A document is split into chunks; each is asked about beside the canon's parts, every one cut to an equal share, with
    what a search has found for the document (rag: doc_id, context) in its first chunk; the answers become one report.
    The canon's text has a fixed size. Documents without any text have no chunks and no report.
    """
    shared = canon_bundle(canon, most_canon)
    chunks = markdown_chunks(docs.select("doc_id", "text"), max_tokens)
    chunks = chunks.withColumn("parts", F.count("*").over(Window.partitionBy("doc_id")))
    known = rag.select("doc_id", F.col("context").alias("_rag")) if rag is not None else docs.select("doc_id", F.lit(None).cast("string").alias("_rag")).limit(0)
    chunks = chunks.join(known, "doc_id", "left")
    part = F.col("section") + 1
    name = F.concat(F.col("doc_id").cast("string"), F.lit(" (sezione: "), F.col("title"), F.lit(", chunk "), part.cast("string"), F.lit("/"), F.col("parts").cast("string"), F.lit(")"))
    asks = gap_prompt(F.lit(shared), F.when(F.col("section") == 0, F.col("_rag")), name, part, F.col("parts"), F.col("title"), truncated_middle(F.col("text"), most_raw, name))
    asked = completed(chunks.select("doc_id", "section", "title", asks.alias("prompt")), complete=complete)
    return merged_parts(asked.withColumn("body", F.coalesce("answer", F.lit(""))), "doc_id", "section", "title", "body")


def project_gap(files: DataFrame, project: str, max_tokens: int, complete: Complete | None = None, limit: int | None = None, sure: str = "SOT") -> DataFrame:
    """gap_report() of one project's files (project, doc_id, rel, text, role): those of the role `sure` are the canon, all
    others are compared with it, at most `limit` of them in order of rel. Files without a role are compared."""
    own = files.where(F.col("project") == project)
    canon = own.where(F.col("role") == sure).select(F.lit(1).alias("tier"), "rel", "text")
    raw = own.where(F.coalesce(F.col("role") != sure, F.lit(True))).where("text is not null")
    raw = raw.orderBy("rel", "doc_id").limit(limit) if limit is not None else raw
    return gap_report(raw.select("doc_id", "text"), canon, max_tokens, complete)


def run_rounds(state: DataFrame, files: DataFrame, n: int, order: list[str], most_rounds: int = 1_000, idle_rounds: int = 3, key: str = "key") -> DataFrame:
    """The state after batches of n until nothing waits, no batch completed anything for some rounds, or so many rounds.

    A file that failed isn't tried again in the same run. Each round is a job whose outcome is written, so a run that
    breaks off goes on from the last state.
    """
    now, idle = state.withColumn("_tried", F.lit(False)), 0
    for _ in range(most_rounds):
        waiting = now.where(~F.col("_tried") & F.col("status").isin(*RESUMABLE))
        if idle == idle_rounds or waiting.isEmpty():
            break
        done = batch(waiting, files, n, order, F.lit(False), key).where("error is not null or status = 'completed'").select(key, F.col("status").alias("_now"))
        done = saved(done)
        idle = 0 if done.where("_now = 'completed'").count() else idle + 1
        now = saved(now.join(done, key, "left").select(*state.columns[: state.columns.index("status")], F.coalesce("_now", "status").alias("status"), *state.columns[state.columns.index("status") + 1 :], (F.col("_tried") | F.col("_now").isNotNull()).alias("_tried")))
    return now.drop("_tried")


def extracted_and_remembered(blocks: DataFrame, max_tokens: int, extract: Callable[[str, str], dict] | None = None) -> tuple[DataFrame, DataFrame]:
    """From blocks of pages to chunk entries, and what reading them one after another leaves in memory."""
    texts = assembled(numbered_pages(blocks), F.col("doc").cast("string"))
    chunks = raw_extract_chunks(texts, max_tokens, key="doc")
    return chunks, remembered(chunks, "doc", "chunk", "text", extract)


#: Condensates that a fragment is read with, code points of an analysis that are condensed, and those that stand for a condensate.
RECENT, CONDENSED_FROM, CONDENSED_TO = 2, 3_000, 400


def fragment_prompt(name: str, place: int, of: int, label: str, text: str, recent: list[str]) -> str:
    """What is asked about one fragment of a document, after the condensates of those just before it; the wording is fixed."""
    before = "".join(f"### Blocco precedente -{len(recent) - i}\n{c}" + ("\n" if i < len(recent) - 1 else "") for i, c in enumerate(recent))
    context = f"\n---\n**Contesto rolling (ultimi blocchi analizzati):**\n{before}\n---\n\n" if recent else ""
    return f"# Documento: `{name}`\n# Frammento {place + 1} di {of}: `{label}`\n{context}## Testo del frammento\n\n{text}"


def condensate(analysis: str, complete: Complete) -> str:
    """What stands under the heading CONDENSATO, if it has more than 30 code points; else what a further call makes of the start
    of the analysis, and if that fails, its first code points."""
    part = analysis.partition("## CONDENSATO")[2].strip().split("##")[0].strip()
    if len(part) > 30:
        return part
    try:
        return complete(analysis[:CONDENSED_FROM]).strip() or analysis[:CONDENSED_TO].strip() or "(condensato non disponibile)"
    except Exception:  # noqa: BLE001  a failed call is a result here
        return analysis[:CONDENSED_TO].strip() or "(condensato non disponibile)"


def sliding_window(chunks: DataFrame, key: str, order: str, label: str, text: str, complete: Complete = stub, most_chars: int | None = None) -> DataFrame:
    """key, order, analysis, condensed and error of each chunk: a document's chunks are read one after another, each with
    the condensates of the two before it.

    A prompt of more than `most_chars` is refused, and so is what fails; a document ends there, and its further chunks
    have no row. Null texts and labels are empty. One group has one document's chunks.
    """
    kind, place = chunks.schema[key].dataType.simpleString(), chunks.schema[order].dataType.simpleString()

    def group(table: pa.Table) -> pa.Table:
        rows, recent, out = table.sort_by(order).to_pylist(), [], []
        for i, r in enumerate(rows):
            ask = fragment_prompt(str(r[key]), i, len(rows), r[label] or "", r[text] or "", recent[-RECENT:])
            try:
                if most_chars is not None and len(ask) > most_chars:
                    raise ValueError(f"prompt of {len(ask)} code points")
                analysis = complete(ask)
            except Exception as e:  # noqa: BLE001  a failed call is a result here
                out.append((r[key], r[order], None, None, str(e)[:500]))
                break
            recent.append(condensate(analysis, complete))
            out.append((r[key], r[order], analysis, recent[-1], None))
        columns = list(zip(*out))
        types = [table.schema.field(key).type, table.schema.field(order).type, pa.string(), pa.string(), pa.string()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=[key, order, "analysis", "condensed", "error"])

    return chunks.select(*dict.fromkeys([key, order, label, text])).groupBy(key).applyInArrow(group, f"{key} {kind}, {order} {place}, analysis string, condensed string, error string")


def enriched(images: DataFrame, chunks: DataFrame, group: str, complete: Complete | None = None) -> tuple[DataFrame, DataFrame]:
    """(images, memory): images that wait for a description are asked about with the texts of their linked chunks; those
    answered are marked, others go on waiting. memory (group, bucket, items) has the insights, one string of JSON for each image."""
    asks = vision_prompts(images, chunks, group)
    task = "Spiega in dettaglio questa immagine nel contesto del documento fornito."
    prompts = asks.select(group, "id", F.concat(F.col("context"), F.lit("\n" + task)).alias("prompt"))
    answers = saved(completed(prompts, complete=complete).where("error is null").select(group, "id", "answer"))
    done = images.join(answers.select(group, "id", F.lit(True).alias("_done")), [group, "id"], "left")
    marked = done.withColumn("vision_processed", F.coalesce("_done", "vision_processed", F.lit(False))).select(*images.columns)
    insight = F.to_json(F.struct(F.col("id").alias("image_id"), F.col("answer").alias("insight")))
    lists = answers.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("id", insight.alias("x")))).alias("xs"))
    return marked, lists.select(group, F.lit("vision_insights").alias("bucket"), F.transform("xs", lambda x: x["x"]).alias("items"))
