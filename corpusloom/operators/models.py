"""Hooks for models that aren't part of the engine: encoder, scorer and answer model, each given as a
function that is called once a batch inside the workers, with the fall-backs that hold without one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.questions import glued, looks_like_followup
from ..functions.text import strip, word_count

Encoder = Callable[[list[str]], np.ndarray]  # texts -> unit rows
Scorer = Callable[[list[str], list[str]], list[float]]  # questions, passages -> relevance
Client = Callable[[str, bool], str]  # (prompt, low effort) -> text, may raise


def encoded(texts: DataFrame, key: str, text: str, encoder: Encoder, batch: int = 256) -> DataFrame:
    """(key, embedding): unit vectors of the texts; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                v = np.asarray(encoder([t or "" for t in part.column(1).to_pylist()]), np.float64)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(v / np.where(norm == 0, 1, norm)), pa.list_(pa.float64()))], [key, "embedding"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInArrow(run, f"{key} {kind}, embedding array<double>")


def scored(pool: DataFrame, question: str, passage: Column, scorer: Scorer | None) -> DataFrame:
    """pool with ``relevance`` of passage for question; null for all rows where there is no scorer or it
    fails, so that the pool's order is kept."""
    rows = pool.withColumn("_passage", passage)
    if scorer is None:
        return pool.withColumn("relevance", F.lit(None).cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            try:
                s = [float(x) for x in scorer(b.column(question).to_pylist(), b.column("_passage").to_pylist())]
            except Exception:  # noqa: BLE001
                s = [None] * b.num_rows
            kept = b.drop_columns(["_passage"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(s, pa.float64())], [*kept.schema.names, "relevance"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pool.schema) + ", relevance double"
    return rows.mapInArrow(run, schema)


# What the answer model and the rewriting model are told.
ANSWER_PROMPT = (
    "Answer the student's question using ONLY the passages below. Cite the source title for every claim. If the passages don't cover part of the question, say so plainly instead of guessing.\n"
    "If a figure applies only to a particular group or year, say which group it applies to. If passages are dated documents that disagree, prefer the most recent one and mention its date.\n\n"
)
REWRITE_PROMPT = (
    "Rewrite the student's latest question so that it can be understood on its own, using their earlier questions for context. Keep it in the student's words, change as little as possible, "
    "and do not answer it. Reply with the rewritten question and nothing else.\n\n"
)


def answer_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit(ANSWER_PROMPT + "Passages:\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer:"))


def _told(client: Client, prompt: str) -> str:
    text = (client(prompt, False) or "").strip() or (client(prompt, True) or "").strip()
    if not text:
        raise ValueError("model returned an empty answer")
    return text


def answered_by_model(rows: DataFrame, prompt: Column, client: Client | None, model: str = "model") -> DataFrame:
    """rows (with ``answer``, the extractive one) with ``answer`` and ``mode``: the model's text, asked a
    second time with little effort if empty; the extractive answer, with the reason, where there is no
    client or it fails. One bad record is a row, never a failed task."""
    if client is None:
        return rows.withColumn("mode", F.lit("extractive (no model)"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said, mode = [], []
            for p, plain in zip(b.column("_prompt").to_pylist(), b.column("answer").to_pylist()):
                try:
                    said.append(_told(client, p))
                    mode.append(f"llm ({model})")
                except Exception as e:  # noqa: BLE001
                    said.append(plain)
                    mode.append(f"extractive (model call failed: {e})")
            kept = b.drop_columns(["_prompt", "answer"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(said, pa.string()), pa.array(mode, pa.string())], [*kept.schema.names, "answer", "mode"])

    others = [f for f in rows.schema if f.name != "answer"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + ", answer string, mode string"
    return rows.select(*(f.name for f in others), "answer", prompt.alias("_prompt")).mapInArrow(run, schema)


def resolved(rows: DataFrame, question: str, history: str, client: Client | None = None) -> DataFrame:
    """rows with ``searched`` and ``note``: a follow-up is rewritten by the model, or joined to the last
    question where there is no client, it fails, or what it says is empty, long or of several lines."""
    past = F.filter(F.coalesce(history, F.array().cast("array<string>")), lambda h: strip(F.coalesce(h, F.lit(""))) != "")
    rows = rows.withColumn("_past", past)
    needs = (F.size("_past") > 0) & looks_like_followup(F.col(question))
    joined = glued(F.col(question), F.element_at("_past", -1))
    if client is None:
        return rows.withColumn("searched", F.when(needs, joined).otherwise(F.col(question))).withColumn("note", F.when(needs, "combined")).drop("_past")
    recent = F.array_join(F.transform(F.when(F.size("_past") > 3, F.slice("_past", -3, 3)).otherwise(F.col("_past")), lambda h: F.concat(F.lit("- "), h)), "\n")
    prompt = F.when(needs, F.concat(F.lit(REWRITE_PROMPT + "Earlier questions:\n"), recent, F.lit("\n\nLatest question: "), F.col(question), F.lit("\n\nRewritten question:")))

    @F.pandas_udf("string")
    def rewrite(prompts):
        def one(p):
            if p is None:
                return None
            try:
                return _told(client, p).strip('"')
            except Exception:  # noqa: BLE001
                return None

        return prompts.map(one)

    rows = rows.withColumn("_said", rewrite(prompt))
    usable = (word_count(F.col("_said")) <= 40) & ~F.col("_said").contains("\n") & (F.col("_said") != "")
    ok = F.coalesce(usable, F.lit(False))
    rows = rows.withColumn("searched", F.when(needs, F.when(ok, F.col("_said")).otherwise(joined)).otherwise(F.col(question)))
    return rows.withColumn("note", F.when(needs, F.when(ok, "rewritten").otherwise("combined"))).drop("_past", "_said")


def first_working(plans: list[tuple[str, Callable[[], DataFrame]]]) -> tuple[str, DataFrame]:
    """The first plan that can be made, with its name: dense and keyword search, else keyword search."""
    last: Exception | None = None
    for name, make in plans:
        try:
            return name, make()
        except Exception as e:  # noqa: BLE001
            last = e
    raise last or ValueError("no plan given")
