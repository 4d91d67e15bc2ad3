"""The engine as one tool with named actions, for a caller that passes plain arguments and wants plain rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import store
from weft.plans.answer import Asker, Options, hybrid
from weft.plans.seams import Model
from weft.sources.documents import static
from weft.streaming import ingest

ACTIONS = ("add_text", "search", "ask", "remove", "stats")


class Tool:
    """A folder of chunks with the actions add_text, search, ask, remove and stats."""

    def __init__(self, spark: SparkSession, folder: str, namespace: str, model: Model | None = None) -> None:
        self.spark, self.folder, self.namespace, self.model = spark, folder, namespace, model

    def chunks(self) -> DataFrame:
        return ingest.current(self.spark, self.folder).where(F.col("namespace") == self.namespace)

    def _corpus(self) -> DataFrame:
        return self.chunks().withColumn("scope", F.col("namespace"))

    def _question(self, text: str, k: int) -> DataFrame:
        if not text.strip():
            raise ValueError("the query is blank")
        return self.spark.createDataFrame([(1, self.namespace, text, k)], "query_id long, scope string, query_text string, top_k int")

    def call(self, action: str, arguments: Mapping[str, object]) -> list[dict[str, object]]:
        """The rows of an action; ValueError for an unknown one or a missing argument."""
        if action not in ACTIONS:
            raise ValueError(f"unknown action {action!r}; known are {', '.join(ACTIONS)}")
        try:
            rows = getattr(self, f"_{action}")(**arguments)
        except TypeError as error:
            raise ValueError(str(error)) from error
        return [r.asDict(recursive=True) for r in rows.collect()]

    def _add_text(self, text: str, doc_id: str, title: str = "", source_id: str = "") -> DataFrame:
        document = static(self.spark, [{"id": doc_id, "title": title, "content": text, "source_id": source_id or doc_id, "metadata": {}}])
        added = ingest.import_chunks(document, self.namespace)
        ingest.commit(self.spark, self.folder, added)
        return added.agg(F.count("*").alias("chunks"))

    def _search(self, query: str, top_k: int = 5) -> DataFrame:
        found = hybrid(self._question(query, top_k), self._corpus())
        return found.join(self.chunks().select("chunk_id", "title", "section_path", "content"), "chunk_id").select("chunk_id", "title", "section_path", "content", "score", "rank").orderBy("rank")

    def _ask(self, query: str, top_k: int = 5) -> DataFrame:
        if self.model is None:
            raise ValueError("a model is needed")
        return Asker(self._corpus(), self.model).ask(self._question(query, top_k), Options()).select("answer", "chunk_ids")

    def _remove(self, chunk_id: str) -> DataFrame:
        gone = store.get(self.chunks(), chunk_id).select("chunk_id")
        ingest.remove_chunks(self.spark, self.folder, gone)
        return self.spark.createDataFrame([(chunk_id,)], "removed string")

    def _stats(self) -> DataFrame:
        return store.stats(self.chunks())
