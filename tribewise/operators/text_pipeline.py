"""The text pipeline as an ML Estimator and Model.

``TextPipeline.fit`` learns a vocabulary (and IDF weights) and returns a ``TextPipelineModel``: tokens by a pattern, stop
words dropped, counts or flags of vocabulary terms, IDF.  Both are stored and loaded with ML's ``write``/``read``; the model keeps its stages
as an ML ``PipelineModel`` and the vocabulary (term_id, term, doc_freq, total_count) as Parquet.

The vocabulary comes from the map-side combined statistics of ``operators.text``, in the order (count
descending, term): ids do not depend on partitions.  Only the cut vocabulary, at most ``vocabSize`` terms, is on the driver.
With IDF, the fit writes the tokens once under the shared folder and reads them for the vocabulary and the weights.

Cases: a null text is a document without tokens; terms outside the vocabulary are dropped; a vocabulary without terms raises.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.feature import IDF, CountVectorizerModel, RegexTokenizer, StopWordsRemover
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tribewise import schemas as S
from tribewise.functions.text import TOKEN_PATTERN, default_stop_words
from tribewise.operators import text as T
from tribewise.session import cut_lineage, drop_state

_STRING, _FLOAT, _INT, _BOOL = (TypeConverters.toString, TypeConverters.toFloat, TypeConverters.toInt, TypeConverters.toBoolean)


class _TextParams(Params):
    inputCol = Param(Params._dummy(), "inputCol", "text column", _STRING)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", _STRING)
    tokensCol = Param(Params._dummy(), "tokensCol", "column of all tokens", _STRING)
    pattern = Param(Params._dummy(), "pattern", "Java pattern of tokens, or of the gaps between them", _STRING)
    matchGaps = Param(Params._dummy(), "matchGaps", "the pattern matches gaps", _BOOL)
    toLowercase = Param(Params._dummy(), "toLowercase", "lower-case before matching", _BOOL)
    stopLanguage = Param(Params._dummy(), "stopLanguage", "language of the stop words; empty for none", _STRING)
    stopCaseSensitive = Param(Params._dummy(), "stopCaseSensitive", "compare stop words with their case", _BOOL)
    minDF = Param(Params._dummy(), "minDF", "fewest documents of a term: a count from 1 on, a share below", _FLOAT)
    maxDF = Param(Params._dummy(), "maxDF", "most documents of a term: a count from 1 on, a share below", _FLOAT)
    minTF = Param(Params._dummy(), "minTF", "fewest occurrences in a document: a count from 1 on, a share of its tokens below", _FLOAT)
    vocabSize = Param(Params._dummy(), "vocabSize", "most terms", _INT)
    binary = Param(Params._dummy(), "binary", "flags instead of counts", _BOOL)
    useIDF = Param(Params._dummy(), "useIDF", "weigh by ln((N + 1) / (df + 1))", _BOOL)

    def __init__(self):
        super().__init__()
        self._setDefault(inputCol=S.DOC_TEXT, outputCol=S.VECTORIZED, tokensCol=S.TOKENS, pattern=TOKEN_PATTERN, matchGaps=False,
                         toLowercase=True, stopLanguage="english", stopCaseSensitive=False, minDF=0.05, maxDF=0.95, minTF=0.0,
                         vocabSize=1 << 18, binary=False, useIDF=False)

    def _words_col(self) -> str:
        return S.FILTERED_TOKENS if self.getOrDefault("stopLanguage") else self.getOrDefault("tokensCol")

    def _clean(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOrDefault("inputCol"), F.coalesce(self.getOrDefault("inputCol"), F.lit("")))


class TextPipeline(_TextParams, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Pattern, stop words, vocabulary bounds, ``minTF``, ``binary`` and IDF in one Estimator."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, tokensCol=None, pattern=None, matchGaps=None, toLowercase=None,
                 stopLanguage=None, stopCaseSensitive=None, minDF=None, maxDF=None, minTF=None, vocabSize=None, binary=None, useIDF=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> TextPipelineModel:
        get = self.getOrDefault
        docs = self._clean(dataset)
        stages = [RegexTokenizer(inputCol=get("inputCol"), outputCol=get("tokensCol"), pattern=get("pattern"),
                                 gaps=get("matchGaps"), toLowercase=get("toLowercase"))]
        if get("stopLanguage"):
            stages.append(StopWordsRemover(inputCol=get("tokensCol"), outputCol=S.FILTERED_TOKENS, caseSensitive=get("stopCaseSensitive"),
                                           stopWords=list(default_stop_words(get("stopLanguage")))))
        words = self._words_col()
        tokens = PipelineModel(stages).transform(docs).select(words)
        if get("useIDF"):  # read twice, for the vocabulary and for the weights: texts are matched once
            tokens = cut_lineage(tokens)
        vocab = T.vocabulary_of_tokens(tokens, words, min_df=get("minDF"), max_df=get("maxDF"), vocab_size=get("vocabSize")).orderBy("term_id")
        rows = vocab.collect()  # at most vocabSize rows
        if not rows:
            raise ValueError("no term is within the bounds of document frequency")
        counted = "_counts" if get("useIDF") else get("outputCol")
        stages.append(CountVectorizerModel.from_vocabulary([r["term"] for r in rows], inputCol=words, outputCol=counted,
                                                           minTF=get("minTF"), binary=get("binary")))
        if get("useIDF"):
            stages.append(IDF(inputCol=counted, outputCol=get("outputCol")).fit(stages[-1].transform(tokens)))
            drop_state(tokens)
        model = TextPipelineModel(PipelineModel(stages), dataset.sparkSession.createDataFrame(rows, vocab.schema))
        return self._copyValues(model)


class TextPipelineModel(_TextParams, Model, MLWritable, MLReadable):
    """A fitted ``TextPipeline``: ``transform``, ``vocabulary``, ``write().save`` and ``load``."""

    def __init__(self, stages: PipelineModel, vocabulary: DataFrame):
        super().__init__()
        self.stages, self.vocabulary = stages, vocabulary

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = self.stages.transform(self._clean(dataset))
        return out.drop("_counts")

    def word_ids(self) -> DataFrame:
        """(term_id, term)."""
        return T.id_to_word(self.vocabulary)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: TextPipelineModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        model, estimator = self.model, TextPipeline()
        model._copyValues(estimator)
        estimator.write().save(f"{path}/params")
        model.stages.write().save(f"{path}/stages")
        model.vocabulary.write.parquet(f"{path}/vocabulary")


class _Reader(MLReader):
    def load(self, path: str) -> TextPipelineModel:
        estimator = TextPipeline.load(f"{path}/params")
        model = TextPipelineModel(PipelineModel.load(f"{path}/stages"), self.sparkSession.read.parquet(f"{path}/vocabulary"))
        return estimator._copyValues(model)


def terms_of_vectors(docs: DataFrame, id_col: str, vocabulary: DataFrame, vector_col: str = S.VECTORIZED) -> DataFrame:
    """(id, term_id, term, weight) of sparse vectors, without making them dense; their entries leave the tasks as Arrow lists."""
    def entries(batches):
        for batch in batches:
            v = batch.column(1)
            v = v.storage if isinstance(v, pa.ExtensionArray) else v
            own = v.is_valid().to_numpy(False) & v.field("indices").is_valid().to_numpy(False)
            rows = np.flatnonzero(own)
            lists = v.take(pa.array(rows))
            ids, weights = lists.field("indices"), lists.field("values")
            at = np.repeat(rows, ids.value_lengths().to_numpy(False))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), ids.flatten(), weights.flatten()], [id_col, "term_id", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    long = docs.select(id_col, vector_col).mapInArrow(entries, f"`{id_col}` {kind}, term_id int, weight double")
    return long.join(vocabulary.select("term_id", "term"), "term_id").select(id_col, "term_id", "term", "weight")
