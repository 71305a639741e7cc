"""Text features (P1/U4): text -> unit vector with pyspark.ml.

The reference uses a pretrained sentence encoder (not rebuilt); the default
here is a hashed TF-IDF pipeline that runs fully distributed (IDF is one
aggregation pass).  A user model can be plugged in through ``embed_with``,
an iterator pandas UDF that loads the model once per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


TOKEN_PATTERN = r"(?U)\W+"  # what parts tokens, in any script


_WORK = ("_sg_tok", "_sg_tf", "_sg_idf", "_sg_vec")


def fit_embedder(df: DataFrame, text: str = "text", dim: int = 256) -> PipelineModel:
    """P1, fit alone: tokens -> hashed term frequencies -> IDF of this corpus
    (one aggregation pass) -> L2 norm."""
    tok, tf, idf, vec = _WORK
    return Pipeline(stages=[RegexTokenizer(inputCol=text, outputCol=tok, pattern=TOKEN_PATTERN, minTokenLength=1),
                            HashingTF(inputCol=tok, outputCol=tf, numFeatures=dim), IDF(inputCol=tf, outputCol=idf),
                            Normalizer(inputCol=idf, outputCol=vec, p=2.0)]).fit(_present(df, text))


def embed(model: PipelineModel, df: DataFrame, out: str = "embedding") -> DataFrame:
    """P1, transform alone: texts of any table in the vector space of the
    corpus that ``model`` was fitted on, as array<double>."""
    text = model.stages[0].getInputCol()
    return model.transform(_present(df, text)).withColumn(out, vector_to_array(_WORK[-1])).drop(*_WORK)


def save_embedder(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_embedder(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def _present(df: DataFrame, text: str) -> DataFrame:
    """A null text counts as empty: its vector is zero."""
    return df.withColumn(text, F.coalesce(F.col(text), F.lit("")))


def embed_text(df: DataFrame, text: str = "text", dim: int = 256, out: str = "embedding") -> DataFrame:
    """Fit on ``df`` and embed it."""
    return embed(fit_embedder(df, text, dim), df, out)


def embed_with(df: DataFrame, text: str, load_model, dim: int, out: str = "embedding") -> DataFrame:
    """U4: embed with a user model (``load_model() -> encode(list[str]) -> 2-D array``),
    loaded once per task inside an iterator pandas UDF (Arrow batches)."""
    @F.pandas_udf("array<float>")
    def enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for s in batches:
            vecs = model(s.fillna("").tolist())
            yield pd.Series([list(map(float, v)) for v in vecs])

    return df.withColumn(out, enc(F.col(text)))
