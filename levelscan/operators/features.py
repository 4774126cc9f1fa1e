"""Text vectors."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, CountVectorizerModel, Normalizer, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F


def tfidf_vectors(df: DataFrame, text: str, size: int = 500) -> DataFrame:
    """Unit TF-IDF vectors over the ``size`` most frequent terms (English stop words removed), as array<double>.

    Terms of equal frequency go by name, so every run has the same vocabulary in the same order.
    """
    tokens = RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"\W+", minTokenLength=2)
    words = StopWordsRemover(inputCol="_tok", outputCol="_words").transform(tokens.transform(df))
    counts = words.select(F.explode("_words").alias("term")).groupBy("term").count()
    terms = [r["term"] for r in counts.orderBy(F.col("count").desc(), "term").limit(size).collect()]
    found = CountVectorizerModel.from_vocabulary(terms, inputCol="_words", outputCol="_tf").transform(words)
    out = Pipeline(stages=[IDF(inputCol="_tf", outputCol="_tfidf"), Normalizer(inputCol="_tfidf", outputCol="_unit")]).fit(found).transform(found)
    return out.withColumn("vector", vector_to_array("_unit")).drop("_tok", "_words", "_tf", "_tfidf", "_unit")
