"""Chats as text for completion, and log-probabilities of their last turn."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (header start, header end, turn end, line feeds after the header) by template.
TEMPLATES = {"llama3": ("<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", 1), "llama4": ("<|header_start|>", "<|header_end|>", "<|eot|>", 2)}


def completions(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", template: str = "llama3") -> DataFrame:
    """(key, prefix, full) of each chat whose last turn is the assistant's: all turns before it with an empty header for it, and all of it."""
    start, end, stop, feeds = TEMPLATES[template]
    header = lambda r: F.concat(F.lit(start), r, F.lit(end + "\n" * feeds))
    said = lambda t: F.concat(header(t["role"]), F.trim(t["text"]), F.lit(stop))
    chats = turns.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")))).alias("t"))
    chats = chats.where(F.element_at("t", -1)["role"] == "assistant")
    before = F.array_join(F.transform(F.slice("t", F.lit(1), F.size("t") - 1), said), "")
    return chats.select(key, F.concat(before, header(F.lit("assistant"))).alias("prefix"), F.array_join(F.transform("t", said), "").alias("full"))


def boundary(tokens: list[str], prompt: str) -> tuple[int | None, str]:
    """The first token after the prompt, by UTF-8 bytes (lone surrogates too), and how it was found or why not: the echo may lack
    the prompt's white space at its end, have other line ends, or be another text; a token may span the end of the prompt."""
    size = lambda t: len(t.encode("utf-8", "surrogatepass"))
    echo, unix = "".join(tokens), lambda t: t.replace("\r\n", "\n")
    if not echo.startswith(prompt):
        if echo.startswith(prompt.rstrip()):
            return None, "whitespace_normalization"
        return None, "crlf_normalization" if unix(echo).startswith(unix(prompt)) else "echo_mismatch"
    want, held = size(prompt), 0
    for i, t in enumerate(tokens):
        held += size(t)
        if held >= want:
            return (i + 1, "exact_match") if held == want else (None, "boundary_spans_token")
    return None, "boundary_not_found"


def suffix_logprobs(rows: DataFrame) -> DataFrame:
    """Of (key, prompt, tokens, logprobs): key, the sum of log-probabilities behind the prompt, and a status; a positive sum is an error."""

    def summed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for key, prompt, tokens, lps in zip(p["key"], p["prompt"], p["tokens"], p["logprobs"], strict=True):
                at, why = boundary(list(tokens), prompt)
                value = float(sum(lps[at:])) if at is not None else None
                out.append((key, None if value is None or value > 0 else value, why if value is None or value <= 0 else "positive"))
            yield pd.DataFrame(out, columns=["key", "logprob", "status"])

    return rows.select("key", "prompt", "tokens", "logprobs").mapInPandas(summed, "key long, logprob double, status string")


def word_count(c: Column) -> Column:
    return F.when(F.trim(c) == "", 0).otherwise(F.size(F.split(F.trim(c), r"\s+")))
