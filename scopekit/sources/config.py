"""Model configuration and prompt templates, as small literal tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopekit import fixed_values as FV
from scopekit import schemas


def model_config(spark: SparkSession, config_json: str = FV.MODEL_CONFIG_JSON) -> DataFrame:
    """(model, context_size, model_path): the JSON object keyed by model name, exploded.

    Its size is the number of configured models (five), so it is safe to broadcast.
    """
    parsed = F.from_json(F.lit(config_json), schemas.MODEL_CONFIG)
    return (spark.range(1)
            .select(F.explode(parsed).alias("model", "cfg"))
            .select("model", F.col("cfg.context_size").alias("context_size"),
                    F.col("cfg.model_path").alias("model_path")))


def read_instruction(path: str | None = None) -> str:
    """Instruction text: the whole template file, or the fixed default."""
    if not path:
        return FV.INSTRUCTION
    with open(path, "r", encoding="utf-8") as f:
        return f.read()


def read_chat_instruction(path: str) -> str:
    """Instruction from a chat-format template: ``content`` of the first JSON line."""
    with open(path, "r", encoding="utf-8") as f:
        return json.loads(f.readline())["content"]


def run_settings(spark: SparkSession, model: str | None = None, model_path: str | None = None,
                 context_size: int | None = None, config_json: str = FV.MODEL_CONFIG_JSON) -> DataFrame:
    """One row (model, context_size, model_path) for a run: the configured model by name,
    else the explicit path and context size. An unknown name is an error, as is neither."""
    if model:
        cfg = json.loads(config_json)
        if model not in cfg:
            raise KeyError(f"model {model!r} is not configured")
        row = (model, int(cfg[model]["context_size"]), cfg[model]["model_path"])
    elif model_path and context_size:
        row = (model_path.rstrip("/").split("/")[-1], int(context_size), model_path)
    else:
        raise ValueError("give a configured model name, or a model path and a context size")
    return spark.createDataFrame([row], "model string, context_size int, model_path string")
