"""Word vectors of texts in long form: (id, term, value) rows, never a dense matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngrams, tokens
from .base import BaseEstimator, ClassifierMixin, TransformerMixin
from .tables import cut


class CountVectorizer(BaseEstimator, TransformerMixin):
    """Vocabulary: the terms in most documents, ties in order of the term."""

    def __init__(self, max_features=5000, min_df=1, ngram_range=(1, 1), arabic_norm=True):
        self.max_features, self.min_df, self.ngram_range, self.arabic_norm = max_features, min_df, ngram_range, arabic_norm

    def terms(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """id, term, tf."""
        grams = ngrams(tokens(F.col(f"`{text_col}`"), arabic=self.arabic_norm), *self.ngram_range)
        return df.select(F.col(f"`{id_col}`").alias("id"), F.explode(grams).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))

    def document_frequencies(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """term, df of the vocabulary."""
        grams = ngrams(tokens(F.col(f"`{text_col}`"), arabic=self.arabic_norm), *self.ngram_range)
        each = df.select(F.explode(F.array_distinct(grams)).alias("term"))  # a row is a text: its terms count once before anything moves
        return each.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= self.min_df).orderBy(F.desc("df"), "term").limit(self.max_features)

    def fit(self, df: DataFrame, id_col: str, text_col: str) -> "CountVectorizer":
        self.id_, self.text_ = id_col, text_col
        self.vocabulary_ = [r["term"] for r in self.document_frequencies(df, id_col, text_col).collect()]  # at most max_features
        return self

    def _vocabulary(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df.sparkSession.createDataFrame([(t, i) for i, t in enumerate(self.vocabulary_)], "term string, index int"))

    def transform(self, df: DataFrame) -> DataFrame:
        """id, index, term, value."""
        self._check_fitted()
        grams = ngrams(tokens(F.col(f"`{self.text_}`"), arabic=self.arabic_norm), *self.ngram_range)
        known = df.select(F.col(f"`{self.id_}`").alias("id"), F.explode(grams).alias("term")).join(self._vocabulary(df), "term")
        return known.groupBy("id", "index", "term").agg(F.count("*").cast("double").alias("value"))

    def get_feature_names_out(self) -> list[str]:
        return list(self.vocabulary_)


class TfidfVectorizer(CountVectorizer):
    """ln(1 + tf) x (ln((1 + n) / (1 + df)) + 1), rows of length 1; n and df are those of the table that is transformed."""

    def transform(self, df: DataFrame) -> DataFrame:
        self._check_fitted()
        tf = cut(super().transform(df))  # read four times; at most max_features rows for each text
        dfs = tf.groupBy("term").agg(F.count("*").alias("df"))
        n = df.select(self.id_).count()
        w = tf.join(F.broadcast(dfs), "term").withColumn("value", F.log1p("value") * (F.log((1 + n) / (1 + F.col("df"))) + 1))
        size = w.groupBy("id").agg(F.greatest(F.sqrt(F.sum(F.col("value") ** 2)), F.lit(1e-12)).alias("size"))
        return w.join(size, "id").select("id", "index", "term", (F.col("value") / F.col("size")).alias("value"))

    def vectors(self, df: DataFrame, out: str = "features") -> DataFrame:
        """``df`` with a sparse vector column."""
        from pyspark.ml.linalg import SparseVector, VectorUDT

        size = len(self.vocabulary_)
        rows = self.transform(df).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("index", "value"))).alias("iv"))

        @F.udf(VectorUDT())
        def sparse(iv):
            return SparseVector(size, [(x["index"], x["value"]) for x in iv or []])

        return df.join(rows.withColumnRenamed("id", "id_"), F.col(f"`{self.id_}`") == F.col("id_"), "left").withColumn(out, sparse("iv")).drop("id_", "iv")


class TextClassifier(BaseEstimator, ClassifierMixin):
    """TF-IDF and logistic regression."""

    def __init__(self, max_features=5000, ngram_range=(1, 2), C=1.0, max_iter=200):
        self.max_features, self.ngram_range, self.C, self.max_iter = max_features, ngram_range, C, max_iter

    def fit(self, df: DataFrame, id_col: str, text_col: str, label: str) -> "TextClassifier":
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import StringIndexer

        self.label_ = label
        self.vec_ = TfidfVectorizer(self.max_features, ngram_range=self.ngram_range).fit(df, id_col, text_col)
        self.index_ = StringIndexer(inputCol=label, outputCol="label_ix_", stringOrderType="alphabetAsc").fit(df)
        self.labels_df_ = df.select(F.col(f"`{label}`").alias("value_"), F.col(f"`{label}`").cast("string").alias("text_")).distinct()
        data = self.index_.transform(self.vec_.vectors(df, "features_"))
        self.model_ = LogisticRegression(featuresCol="features_", labelCol="label_ix_", maxIter=self.max_iter, regParam=1 / (self.C * max(1, data.count())), standardization=False, rawPredictionCol="raw_", probabilityCol="probability", predictionCol="ix_").fit(data)
        return self

    def predict_proba(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        self._check_fitted()
        return self.model_.transform(self.vec_.vectors(df, "features_")).withColumn("probability", vector_to_array("probability")).drop("features_", "raw_")

    def predict(self, df: DataFrame) -> DataFrame:
        names = F.array(*[F.lit(x) for x in self.index_.labels])
        out = self.predict_proba(df).withColumn("text_", F.element_at(names, F.col("ix_").cast("int") + 1))
        return out.join(F.broadcast(self.labels_df_), "text_").withColumnRenamed("value_", "prediction").drop("text_", "ix_")
