"""From ranked documents to passages, context and chat history."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def passages(ranked: DataFrame, documents: DataFrame, k: int = 5, chars: int = 1000) -> DataFrame:
    """``(query_id, pos, file, title, score, text)`` of the best ``k`` documents of each query; a
    document without a title goes by its path."""
    name = F.coalesce("title", "path") if "title" in documents.columns else F.col("path")
    of = documents.select(F.col("path").alias("file"), name.alias("title"), F.substring("text", 1, chars).alias("text"))
    return ranked.where(F.col("pos") < k).select("query_id", "pos", "file", "score").join(of, "file").select("query_id", "pos", "file", "title", "score", "text")


def context(found: DataFrame) -> DataFrame:
    """``(query_id, context)``: numbered passages. A query has at most ``k`` of them."""
    part = F.concat(F.lit("["), (F.col("pos") + 1).cast("string"), F.lit("] "), "title", F.lit(":\n"), "text")
    rows = F.array_sort(F.collect_list(F.struct("pos", part.alias("part"))))
    return found.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda x: x["part"]), "\n\n").alias("context"))


def sources(text: str) -> list[str]:
    """Names in lines ``[n] name:``, each once, in order."""
    return list(dict.fromkeys(re.findall(r"(?m)^\[\d+\] (.*):$", text)))


def answer(question: str, context_text: str, generate: Callable[[str], str | None]) -> dict:
    reply = generate(f"Answer from the context.\n\n{context_text}\n\nQuestion: {question}") if context_text else None
    return {"answer": reply or "Unable to retrieve relevant context.", "sources": sources(context_text)}


def trim_history(messages: DataFrame, most: int) -> DataFrame:
    """The last ``2 * most`` messages of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= 2 * most).drop("_n")


def details(row: dict) -> list[str]:
    """A hit's sub-scores, judgement and blend share as lines, where it has them."""
    out = [f"{n}: {row[n]:.3f}" + (f" (rank {row[r] + 1})" if row.get(r) is not None else "") for n, r in (("fts_score", "fts_rank"), ("vec_score", "vec_rank"), ("tag_score", "tag_rank")) if row.get(n) is not None]
    if row.get("rerank_score") is not None:
        out.append(f"rerank: {row['rerank_score']:.3f}" + (f" ({'relevant' if row['relevant'] else 'not relevant'})" if row.get("relevant") is not None else ""))
    if row.get("blend_weight") is not None:
        out.append(f"blend: {row['blend_weight']:.0%} fused, {1 - row['blend_weight']:.0%} rerank")
    return out


def show(rows: list[dict], form: str = "text") -> str:
    """Ranked rows as text, json, csv, xml, md or files; for what a caller has already cut to a page."""
    names = list(rows[0]) if rows else []
    if form == "json":
        return json.dumps(rows, default=str)
    if form == "csv":
        quote = lambda v: '"' + str(v).replace('"', '""') + '"'
        return "\n".join([",".join(names), *(",".join(quote(r[n]) for n in names) for r in rows)])
    if form == "md":
        return "\n".join(["| " + " | ".join(names) + " |", "|" + "-|" * len(names), *("| " + " | ".join(str(r[n]) for n in names) + " |" for r in rows)])
    if form == "xml":
        safe = lambda v: str(v).replace("&", "&amp;").replace("<", "&lt;")
        return "<results>" + "".join("<result>" + "".join(f"<{n}>{safe(r[n])}</{n}>" for n in names) + "</result>" for r in rows) + "</results>"
    if form not in ("text", "files"):
        raise ValueError(f"unknown format {form!r}")
    if form == "files":
        return "\n".join(str(r.get("file")) for r in rows)
    lines = []
    for i, r in enumerate(rows):
        name = f"{r['title']} - {r['file']}" if r.get("title") else r.get("file")
        lines.append(f"{i + 1}. {name} {r.get('score'):.3f}" + (f" ({r['sources_count']} sources)" if r.get("sources_count") else ""))
        lines += ["   " + d for d in details(r)]
    return "\n".join(lines)
