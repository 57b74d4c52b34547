"""Questions to answers: the boundaries to embedders, vector tables and language models, with forms that need no network, and the engine over them."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight import config
from quarrylight.functions import hashes, predicates, text
from quarrylight.operators import catalogs, lexical, retrieval, rows, vectors
from quarrylight.sources.tables import Table

CHUNKS = "chunk_id string, source_url string, source_type string, source_domain string, page_kind string, doc_title string, heading_path string, chunk_text string, content_sha1 string, embedding array<float>"


class Embedder(Protocol):
    dim: int

    def embed_texts(self, texts: DataFrame, column: str) -> DataFrame: ...

    def embed_query(self, said: str) -> list[float]: ...


class LLM(Protocol):
    def build_prompt(self, question: Column, sources: Column, history: Column) -> Column: ...

    def generate(self, prompts: DataFrame) -> DataFrame: ...

    def generate_stream(self, prompt: str, sources: list[dict]) -> Iterator[str]: ...

    def complete(self, prompt: str) -> str: ...


#: Bytes, and texts, whose words are hashed at a time; a longer text is one by itself.
PIECE, PIECE_TEXTS = 1 << 18, 512


def bags(texts: list[bytes], dim: int, unit: bool = True) -> np.ndarray:
    """A row a text (in lower case): its hashed words, by their number and a sign (the hash's first bit), with length 1 if `unit`."""
    row, h = hashes.word_hashes(texts)
    out = np.bincount(row * dim + h % dim, np.where(h >> 31, 1.0, -1.0), len(texts) * dim).astype(np.float32).reshape(-1, dim)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, 1) if unit else out


def lowered(said: str) -> bytes:
    return said.lower().encode("utf-8", "surrogatepass")


@dataclass
class HashedBag:
    """An embedder without a model: hashed bags of words, as the default where no model is given."""

    dim: int = 256
    unit: bool = True

    def embed_texts(self, texts: DataFrame, column: str) -> DataFrame:
        dim, unit = self.dim, self.unit

        @F.arrow_udf("array<float>")
        def embed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for part in parts:
                made = np.empty((len(part), dim), np.float32)
                at, texts, held = 0, [], 0
                for said in part:  # a piece of texts at a time are Python objects
                    texts.append(lowered(said.as_py() or ""))
                    held += len(texts[-1])
                    if held >= PIECE or len(texts) == PIECE_TEXTS:
                        made[at : at + len(texts)] = bags(texts, dim, unit)
                        at, texts, held = at + len(texts), [], 0
                if texts:
                    made[at:] = bags(texts, dim, unit)
                yield pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, dim), pa.int32()), pa.array(made.ravel()))

        return texts.withColumn("embedding", embed(column))

    def embed_query(self, said: str) -> list[float]:
        return bags([lowered(said)], self.dim, self.unit)[0].tolist()


def prompt(question: Column, sources: Column, history: Column) -> Column:
    """What a model is asked: history, numbered sources of 1,200 characters at most, and the question."""
    one = lambda s, i: F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit("] "), F.coalesce(s["doc_title"], F.lit("")), F.lit(" — "), F.coalesce(s["heading_path"], F.lit("")), F.lit("\n"), F.substring(F.coalesce(s["chunk_text"], F.lit("")), 1, 1200))
    return F.concat_ws("\n\n", F.nullif(history, F.lit("")), F.array_join(F.transform(sources, one), "\n\n"), F.concat(F.lit("Question: "), question))


class Extractive:
    """A language model's place taken by sentences of the sources, with their marks."""

    def __init__(self, chars: int = 400, shown: int = 3):
        self.chars, self.shown = chars, shown

    def build_prompt(self, question: Column, sources: Column, history: Column) -> Column:
        return prompt(question, sources, history)

    def generate(self, prompts: DataFrame) -> DataFrame:
        """(query_id, answer) of (query_id, question, sources, prompt), sources being an array of structs with doc_title and chunk_text."""
        line = lambda s, i: F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit("] "), F.substring(F.regexp_replace(F.coalesce(s["chunk_text"], F.lit("")), r"\s+", " "), 1, self.chars))
        return prompts.select("query_id", F.array_join(F.transform(F.slice("sources", 1, self.shown), line), "\n").alias("answer"))

    def generate_stream(self, prompt: str, sources: list[dict]) -> Iterator[str]:
        """The same answer a word at a time, each with the white space after it, made as it is read."""
        for i, source in enumerate(sources[: self.shown]):
            said = re.sub(r"[ \t\n\x0b\f\r]+", " ", source["chunk_text"] or "")[: self.chars]
            yield from re.findall(r"\S+\s*|\s+", f"[Source {i + 1}] {said}" + ("\n" if i + 1 < min(len(sources), self.shown) else ""))

    def complete(self, prompt: str) -> str:
        return prompt[: self.chars]


class VectorStore:
    """Chunks with vectors in a table, its folders by kind of source."""

    def __init__(self, spark: SparkSession, path: str, dim: int):
        self.dim, self.spark = dim, spark
        self.table = Table(spark, path, CHUNKS, key="chunk_id", part="source_type")

    def upsert_chunks(self, chunks: DataFrame) -> None:
        """Chunks replace those of the same id; a vector of another length raises an error."""
        size = F.size("embedding")
        checked = F.when(size == self.dim, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit(f"a vector of {self.dim} was due, not of "), size.cast("string"))))
        self.table.upsert(chunks.withColumn("embedding", checked.cast("array<float>")))

    def query(self, questions: DataFrame, top_k: int, source: str = "all", metadata: dict | None = None) -> DataFrame:
        """(query_id, chunk columns, score, rank): the nearest chunks of (query_id, query), a vector, under the filters.

        Where questions have a column `source`, each searches its own source;
        all of them still meet every chunk once.
        """
        own = "source" in questions.columns
        kept = self.rows("all" if own else source).filter(predicates.compiled(metadata))
        # a chunk's label has a bit for each source that it belongs to
        bits = [F.when(predicates.source_filter(name, F.col("source_type"), F.col("source_domain")), 1 << i).otherwise(0) for i, name in enumerate(config.SOURCES)]
        numbered = kept.withColumn("vec_id", F.xxhash64("chunk_id")).withColumn("label", reduce(lambda a, b: a + b, bits) if own else F.lit(0))
        wanted = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, config.SOURCES)), F.col("source")), F.lit(0)), F.lit(1)) - 1 if own else F.lit(0)
        asked = questions.select("query_id", "query", wanted.alias("query_label")).withColumn("no", F.xxhash64(F.col("query_id").cast("string")))
        allowed = (lambda labels, wanted, _: (labels[:, None] >> wanted[None, :]) & 1 == 1) if own else None
        near = vectors.top_k(numbered, asked.select(F.col("no").alias("query_id"), "query", "query_label"), top_k, allowed)
        named = asked.select(F.col("no").alias("q"), F.col("query_id").alias("asked"))
        found = near.join(named, near["query_id"] == named["q"]).select(F.col("asked").alias("query_id"), "vec_id", F.col("score"), "rank")
        return found.join(numbered.drop("embedding", "label"), "vec_id").drop("vec_id")

    def hybrid(self, questions: DataFrame, top_k: int, each: int | None = None, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
        """(query_id, chunk columns, score, rank) of questions (query_id, question, query): the nearest chunks and the best by words, `each` of both, in one list by their ranks."""
        each = each or 2 * top_k
        chunks = self.rows().withColumn("doc_id", F.xxhash64("chunk_id"))
        asked = questions.withColumn("no", F.xxhash64(F.col("query_id").cast("string")))
        dense = vectors.top_k(chunks.withColumnRenamed("doc_id", "vec_id").withColumn("label", F.lit(0)), asked.select(F.col("no").alias("query_id"), "query", F.lit(0).alias("query_label")), each).withColumnRenamed("vec_id", "doc_id")
        words = lexical.top_k(lexical.index(chunks, "doc_id", "chunk_text"), asked.select(F.col("no").alias("query_id"), F.col("question").alias("query")), each)
        both = lexical.fused([(dense, weights[0]), (words, weights[1])], top_k).withColumnRenamed("query_id", "no")
        return both.join(asked.select("no", "query_id"), "no").join(chunks.drop("embedding"), "doc_id").drop("no", "doc_id")

    def rows(self, source: str = "all") -> DataFrame:
        """Rows of a source; where it is one kind, only that kind's folder is read."""
        allowed = predicates.source_filter(source, F.col("source_type"), F.col("source_domain"))
        parts = [source] if source in ("drive", "whatsapp") else None
        return self.table.read(parts).filter(allowed)

    def delete_by_filter(self, metadata: dict) -> None:
        self.table.delete(predicates.compiled(metadata) if metadata else None)

    def describe_stats(self) -> dict:
        by = {r.source_type: r.n for r in self.table.read().groupBy("source_type").agg(F.count("*").alias("n")).collect()}  # kinds of sources: a few
        return {"vectors": sum(by.values()), "by_source": by, "dim": self.dim}


class QueryEngine:
    """ask, ask_stream, inspect_retrieve and inspect over a store; `answers` does the same for a table of questions. Catalogs, if given, answer comparisons and counts."""

    def __init__(self, spark: SparkSession, store: VectorStore, embedder: Embedder, llm: LLM | None = None, least: float = config.MIN_SCORE, known: catalogs.Catalogs | None = None):
        self.spark, self.store, self.embedder, self.llm, self.least, self.known = spark, store, embedder, llm or Extractive(), least, known

    def prepared(self, questions: DataFrame) -> DataFrame:
        """Questions (query_id, question, source, prior, and history if there is any) with the source to search and what to search for."""
        q = questions if "history" in questions.columns else questions.withColumn("history", F.lit(""))
        q = q.withColumn("resolved", retrieval.resolved_source(F.col("question"), F.col("source"), F.col("prior")))
        return q.withColumn("search_text", retrieval.search_text(F.col("question"), F.col("prior")))

    def retrieve(self, questions: DataFrame) -> DataFrame:
        """Chosen chunks of questions in their order; a source that has nothing for a question is searched as all."""
        embedded = self.embedder.embed_texts(self.prepared(questions), "search_text").withColumnRenamed("embedding", "query")
        q = rows.stored(embedded.select("query_id", "question", "search_text", "resolved", "query"))
        most = max(config.LIST_LIMITS[2], config.PACKAGE_LIMITS[2], config.LIMITS[2])
        found = rows.stored(self.store.query(q.select("query_id", "query", F.col("resolved").alias("source")), most))
        missed = q.filter("resolved <> 'all'").join(found.select("query_id").distinct(), "query_id", "left_anti")
        if missed.head(1):
            found = found.unionByName(self.store.query(missed.select("query_id", "query"), config.LIST_LIMITS[2], "all"))
        found = found.join(retrieval.asked(q).select("query_id", "top_k"), "query_id").filter("rank <= top_k").drop("top_k")
        return retrieval.retrieve(q.select("query_id", "question", "search_text"), found, self.store.rows(), self.least)

    def prompts(self, questions: DataFrame) -> DataFrame:
        """(query_id, question, sources, prompt): what the model is to answer from, for questions that retrieval finds something for."""
        card = F.struct("position", *retrieval.CHUNK, "score")
        chosen = self.retrieve(questions).groupBy("query_id").agg(F.array_sort(F.collect_list(card)).cast(catalogs.SOURCE).alias("sources"))
        asked = self.prepared(questions).select("query_id", "question", "history").join(chosen, "query_id")
        return asked.select("query_id", "question", "sources", self.llm.build_prompt(F.col("question"), F.col("sources"), F.col("history")).alias("prompt"))

    def fixed(self, questions: DataFrame) -> DataFrame:
        """(query_id, route, answer, sources) of the questions that catalogs answer."""
        if self.known is None:
            return self.spark.createDataFrame([], f"query_id {dict(questions.dtypes)['query_id']}, route string, answer string, sources {catalogs.SOURCE}")
        return rows.stored(catalogs.answers(questions.select("query_id", "question"), self.known))

    def answers(self, questions: DataFrame) -> DataFrame:
        """(query_id, route, answer, sources, resolved): every question gets one, from catalogs or from what was retrieved; those without sources what is said then."""
        fixed = self.fixed(questions)
        rest = questions.join(fixed.select("query_id"), "query_id", "left_anti")
        prompts = rows.stored(self.prompts(rest))
        said = prompts.select("query_id", "sources").join(self.llm.generate(prompts), "query_id").select("query_id", F.lit("retrieve").alias("route"), "answer", "sources")
        every = self.prepared(questions).select("query_id", "resolved").join(fixed.unionByName(said), "query_id", "left")
        return every.withColumn("route", F.coalesce("route", F.lit("retrieve"))).withColumn("answer", F.coalesce("answer", retrieval.empty_message(F.col("resolved"))))

    def _one(self, question: str, source: str, history: list[dict] | None) -> DataFrame:
        if (source or "all").lower() not in (*config.SOURCES, "blog"):
            raise ValueError(f"unknown source {source!r}")
        turns = [((t.get("role") or "").strip().lower(), (t.get("content") or "").strip()) for t in (history or [])[-8:]]
        turns = [(role, said[:2000]) for role, said in turns if role in ("user", "assistant") and said]
        users = [said for role, said in turns if role == "user"]
        before = "\n".join(f"{role.capitalize()}: {said}" for role, said in turns)
        return self.spark.createDataFrame([(0, question, source or "all", users[-1] if users else "", before)], "query_id long, question string, source string, prior string, history string")

    def ask(self, question: str, source: str = "all", history: list[dict] | None = None) -> dict:
        """{answer, sources} of one question."""
        r = self.answers(self._one(question, source, history)).first()
        return {"answer": r.answer, "sources": [s.asDict() for s in r.sources or []]}

    def ask_stream(self, question: str, source: str = "all", history: list[dict] | None = None) -> Iterator[dict]:
        """The answer as events: sources, then tokens as the model gives them, done, and related questions if there are any. Tokens joined are the answer."""
        one = self._one(question, source, history)
        found = self.fixed(one).first() or self.prompts(one).first()
        sources = [s.asDict() for s in found.sources] if found else []
        yield {"type": "sources", "payload": sources}
        if found and "prompt" in found:
            tokens = self.llm.generate_stream(found.prompt, sources)
        else:
            whole = found.answer if found else self.prepared(one).select(retrieval.empty_message(F.col("resolved"))).first()[0]
            tokens = re.findall(r"\S+\s*|\s+", whole)
        said = []
        for token in tokens:
            said.append(token)
            yield {"type": "token", "payload": token}
        yield {"type": "done", "payload": ""}
        related = self.suggest_related_questions(question, "".join(said))
        if related:
            yield {"type": "related", "payload": related}

    def suggest_related_questions(self, question: str, answer: str) -> list[str]:
        said = self.llm.complete(f"Three questions that go on from this, as a JSON list.\nQuestion: {question}\nAnswer: {answer}")
        return self.spark.createDataFrame([(said,)], "t string").select(text.related_questions(F.col("t")).alias("r")).first().r

    def inspect_retrieve(self, question: str, source: str = "all", history: list[dict] | None = None) -> list[dict]:
        return [r.asDict() for r in self.retrieve(self._one(question, source, history)).orderBy("position").select("position", *retrieval.CHUNK, "score").collect()]  # max_returned rows at most

    def inspect(self, state: DataFrame | None = None) -> dict:
        """What the store has, and the state table (status) if it is given."""
        counts = {r.status: r.n for r in state.groupBy("status").agg(F.count("*").alias("n")).collect()} if state is not None else {}
        return {"store": self.store.describe_stats(), "state": counts}


def health() -> str:
    return json.dumps({"status": "ok"})
