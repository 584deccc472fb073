"""Batched generation: prompts of like length meet, longest first, and a row's failure stays its own.

Prompts are dealt to tasks by ranges of their length and sorted within, so a batch holds neighbours in length and
little of it is padding. Equal lengths are ranged by a hash too, so a length that most prompts have is no single
task's. A model is made once in a Python worker and serves its tasks; a batch that fails is tried again row by row, and what a
row fails with is its result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import whitespace_tokens

#: A model takes the prompts of a batch and gives an answer for each.
Model = Callable[[list[str]], list[str]]
_MADE: dict[str, Model] = {}


@dataclass(frozen=True)
class Batching:
    rows: int = 16  # of a batch at most
    tokens: int = 16_384  # of a batch at most, padding included; a longer prompt is a batch by itself
    padding: float = 0.25  # share of a batch's tokens that may be padding


def model_of(name: str | None, make: Callable[[], Model]) -> Model:
    """The worker's model of that name, made when it is first asked for; without a name, a new one."""
    if name is None:
        return make()
    if name not in _MADE:
        _MADE[name] = make()
    return _MADE[name]


def batches(lengths: Iterator[int], rule: Batching) -> Iterator[int]:
    """How many of the lengths, which fall, each batch takes."""
    n = longest = total = 0
    for length in lengths:
        whole = longest * (n + 1)
        if n and (n == rule.rows or whole > rule.tokens or whole - total - length > rule.padding * whole):
            yield n
            n = total = 0
        if not n:
            longest = max(length, 1)
        n, total = n + 1, total + length
    if n:
        yield n


def answered(model: Model, prompts: list[str]) -> list[tuple[str | None, str | None]]:
    """(answer, error) of each prompt of a batch."""
    try:
        found = list(model(prompts))
        if len(found) != len(prompts):
            raise ValueError(f"{len(found)} answers to {len(prompts)} prompts")
        return [(a, None) for a in found]
    except Exception as error:  # a row's failure is its result
        if len(prompts) == 1:
            return [(None, f"{type(error).__name__}: {str(error)[:200]}")]
        return [x for p in prompts for x in answered(model, [p])]


def generate(prompts: DataFrame, make: Callable[[], Model], name: str | None = None, rule: Batching = Batching(), length: Column | None = None) -> DataFrame:
    """query_id, answer, error, n_tokens, batch_rows and padded (tokens of the batch's longest) for prompts (query_id, prompt).

    length counts a prompt's tokens, by default its words. A null prompt has the error "no prompt". Every row of
    prompts has one row; its id may be repeated.
    """
    kind = prompts.schema["query_id"].dataType.simpleString()
    n = F.coalesce(F.size(whitespace_tokens(F.col("prompt"))) if length is None else length, F.lit(0)).cast("int")
    sized = prompts.select("query_id", "prompt", n.alias("n_tokens"))
    dealt = sized.repartitionByRange(F.col("n_tokens").desc(), F.xxhash64("query_id", "prompt")).sortWithinPartitions(F.col("n_tokens").desc())
    columns = ["query_id", "answer", "error", "n_tokens", "batch_rows", "padded"]

    def finished(model: Model, rows: pd.DataFrame) -> pd.DataFrame:
        out = rows[["query_id", "n_tokens"]].assign(batch_rows=len(rows), padded=int(rows["n_tokens"].max()), answer=None, error="no prompt")
        given = rows["prompt"].notna().to_numpy()
        if given.any():
            found = answered(model, rows["prompt"][given].tolist())
            out.loc[given, "answer"], out.loc[given, "error"] = pd.Series([a for a, _ in found], out.index[given], object), pd.Series([e for _, e in found], out.index[given], object)
        return out[columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, held = None, pd.DataFrame(columns=["query_id", "prompt", "n_tokens"])
        for frame in frames:
            model = model or model_of(name, make)
            held = pd.concat([held, frame], ignore_index=True) if len(held) else frame.reset_index(drop=True)
            done, sizes = 0, list(batches(iter(held["n_tokens"].tolist()), rule))
            for size in sizes[:-1]:  # the last batch may go on in the next frame
                yield finished(model, held.iloc[done : done + size].reset_index(drop=True))
                done += size
            held = held.iloc[done:].reset_index(drop=True)
        if len(held):
            yield finished(model, held)

    return dealt.mapInPandas(run, f"query_id {kind}, answer string, error string, n_tokens int, batch_rows int, padded int")


def prompts_of(questions: DataFrame, documentation: DataFrame, instruction: str = "Answer from the documentation. If it does not hold the answer, say NOT FOUND.") -> DataFrame:
    """query_id and prompt: the instruction, each question's documentation (query_id, documentation; none: empty), and the question (query_id, text)."""
    joined = questions.select("query_id", "text").join(documentation.select("query_id", "documentation"), "query_id", "left")
    return joined.select("query_id", F.concat_ws("\n\n", F.lit(instruction), F.coalesce("documentation", F.lit("")), F.concat(F.lit("Question: "), F.coalesce("text", F.lit("")))).alias("prompt"))
