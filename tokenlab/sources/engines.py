"""Generation by an engine of the caller's: prompts go out per problem and chain, chains come back as run records.

An engine is made once in each Python worker by a factory, and is called with lists of prompts and seeds. Engines that
need packages of their own import them when they are made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.answers import request_seed
from ..operators.text import prompt
from .records import CHAIN, struct

#: (prompts, seeds, cap) -> for each prompt text, token_ids, finish_reason and stop_reason.
Engine = Callable[[list[str], list[int], int], list[dict[str, Any]]]


def generate(problems: DataFrame, factory: Callable[[], Engine], cap: int, n_chains: int, base_seed: int, family: str = "qwen", at_once: int = 64) -> DataFrame:
    """problems with chains, n_chains each, whose seeds follow from base_seed, problem and place.

    Chains are rows of their own while they are generated, so one problem's chains can run on several workers; an
    engine gets at_once prompts at most. A chain of more than cap tokens is an error.
    """
    rows = problems.select("problem_id", prompt(F.col("question"), family).alias("prompt"), F.explode(F.sequence(F.lit(0), F.lit(n_chains - 1))).alias("chain_index"))
    rows = rows.withColumn("request_seed", request_seed(F.lit(base_seed), F.col("problem_id"), F.col("chain_index")).cast("string"))
    made = T.StructType([problems.schema["problem_id"], T.StructField("chain_index", T.IntegerType()), *struct(text=T.StringType(), token_ids=T.ArrayType(T.IntegerType()), finish_reason=T.StringType(), stop_reason=T.StringType()).fields])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = None
        for part in parts:
            engine = engine or factory()
            for at in range(0, len(part), at_once):
                own = part.iloc[at : at + at_once]
                out = engine(own["prompt"].tolist(), [int(s) for s in own["request_seed"]], cap)
                if len(out) != len(own) or any(len(c["token_ids"]) > cap or c["finish_reason"] not in ("stop", "length") for c in out):
                    raise ValueError("the engine's chains don't fit the request")
                yield pd.DataFrame({"problem_id": own["problem_id"].tolist(), "chain_index": own["chain_index"].tolist(), "text": [c["text"] for c in out], "token_ids": [[int(t) for t in c["token_ids"]] for c in out], "finish_reason": [c["finish_reason"] for c in out], "stop_reason": [c.get("stop_reason") for c in out]})

    chains = rows.repartition("problem_id", "chain_index").mapInPandas(run, made)
    seed = request_seed(F.lit(base_seed), F.col("problem_id"), F.col("chain_index"))
    fields = {"text": F.col("text"), "token_count": F.size("token_ids"), "finish_reason": F.col("finish_reason"), "stop_reason": F.col("stop_reason"), "chain_index": F.col("chain_index"), "request_seed": seed, "token_ids": F.col("token_ids")}
    whole = F.struct(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CHAIN.fields])
    # Chains sort by their place, which comes first in what is collected.
    packed = chains.select("problem_id", F.struct("chain_index", whole.alias("c")).alias("x")).groupBy("problem_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["c"]).alias("chains"))
    return problems.drop("chains").join(packed, "problem_id", "left")


def transformers_engine(model: str, temperature: float = 0.0, top_p: float = 1.0) -> Callable[[], Engine]:
    """A factory over the transformers package, one sequence at a time under its own seed."""

    def make() -> Engine:
        import torch
        from transformers import AutoModelForCausalLM, AutoTokenizer

        tokenizer, net = AutoTokenizer.from_pretrained(model), AutoModelForCausalLM.from_pretrained(model)

        def engine(prompts: list[str], seeds: list[int], cap: int) -> list[dict[str, Any]]:
            out = []
            for text, seed in zip(prompts, seeds, strict=True):
                torch.manual_seed(seed % (1 << 63))
                given = tokenizer(text, return_tensors="pt", add_special_tokens=False)
                how = {"do_sample": True, "temperature": temperature, "top_p": top_p} if temperature else {"do_sample": False}
                ids = net.generate(**given, max_new_tokens=cap, **how)[0][given["input_ids"].shape[1] :].tolist()
                ended = bool(ids) and ids[-1] == tokenizer.eos_token_id
                out.append({"text": tokenizer.decode(ids, skip_special_tokens=True), "token_ids": ids, "finish_reason": "stop" if ended else "length", "stop_reason": None})
            return out

        return engine

    return make


def vllm_engine(model: str, temperature: float = 0.0, top_p: float = 1.0, **settings: Any) -> Callable[[], Engine]:
    """A factory over the vllm package; prompts run together, each under its own seed."""

    def make() -> Engine:
        from vllm import LLM, SamplingParams

        net = LLM(model=model, **settings)

        def engine(prompts: list[str], seeds: list[int], cap: int) -> list[dict[str, Any]]:
            how = [SamplingParams(max_tokens=cap, temperature=temperature, top_p=top_p, seed=s % (1 << 63)) for s in seeds]
            done = [r.outputs[0] for r in net.generate(prompts, how)]
            return [{"text": c.text, "token_ids": list(c.token_ids), "finish_reason": c.finish_reason, "stop_reason": None if c.stop_reason is None else str(c.stop_reason)} for c in done]

        return engine

    return make


def first_that_loads(spark: SparkSession, names: list[str], load: Callable[[SparkSession, str], DataFrame]) -> tuple[str, DataFrame]:
    """The first of several names of one data set that loads, with its rows; all errors if none does."""
    errors = {}
    for name in names:
        try:
            rows = load(spark, name)
            rows.limit(1).collect()
            return name, rows
        except Exception as e:  # the next name may do
            errors[name] = f"{type(e).__name__}: {e}"[:200]
    raise ValueError(f"none of the names loads: {errors}")
