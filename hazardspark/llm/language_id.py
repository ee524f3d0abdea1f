"""Language ID by prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to ORDER bytes, counted once and
then frozen. A byte costs -log2 of its share where its longest context has
seen it; where not, the escape of that context (distinct / (total + distinct), method C)
is paid and the next shorter context is asked, down to a flat guess. The text
goes to the language with the shortest code. ASCII letters are lower-cased, and
bytes beyond the commonest of the training text share one symbol.

As the trees are frozen, a cost depends on the last ORDER + 1 bytes only: one gather
from a table of the costs of every symbol in every context that was seen, or from
the costs of shorter contexts where it was not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardspark.llm import common as c

ORDER = 3
SYMBOLS = 64
BITS = 6
PER_LANGUAGE = 2000


def symbols_of(texts: list[bytes]) -> np.ndarray:
    """Byte to symbol: the commonest bytes have their own, 0 is all others and what precedes a text."""
    count = np.bincount(c.LOWER[np.frombuffer(b"".join(texts), dtype=np.uint8)], minlength=256)
    best = np.lexsort((np.arange(256), -count))[: SYMBOLS - 1]
    out = np.zeros(256, dtype=np.uint32)
    best = best[count[best] > 0]
    out[best] = np.arange(1, len(best) + 1)
    return out[c.LOWER]


def coded(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the texts, one after another, its last ORDER + 1 symbols as a number; where each text begins."""
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    s = table[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    code = s.copy()
    for k in range(1, ORDER + 1):
        before = np.zeros_like(s)
        before[k:] = s[:-k] if len(s) > k else 0
        for j in range(k):  # nothing from the text before
            place = at[:-1][np.diff(at) > j] + j
            before[place] = 0
        code |= before << np.uint32(BITS * k)
    return code, at


class Model:
    """Frozen context trees of all languages as tables of costs in bits."""

    def __init__(self, table: np.ndarray, langs: list[str], trees: list[list[tuple[np.ndarray, np.ndarray]]]):
        """trees[l][k]: distinct codes of k + 1 symbols and their counts."""
        self.table, self.langs = table, langs
        n = len(langs)
        cost = np.full((SYMBOLS, n), np.log2(SYMBOLS), dtype=np.float32)  # below order 0
        for k in range(ORDER):
            cost = self._longer(cost, trees, k, np.arange(SYMBOLS**k))
        top = np.unique(np.concatenate([t[ORDER][0] // SYMBOLS for t in trees])) if n else np.empty(0, dtype=np.int64)
        self.low, self.seen = cost, self._longer(cost, trees, ORDER, top)
        self.row = np.full(SYMBOLS**ORDER, -1, dtype=np.int32)
        self.row[top] = np.arange(len(top))

    def _longer(self, shorter: np.ndarray, trees: list, k: int, contexts: np.ndarray) -> np.ndarray:
        """Costs of every symbol after these contexts of k symbols, given those after contexts one symbol shorter."""
        out = np.empty((len(contexts) * SYMBOLS, len(trees)), dtype=np.float32)
        code = (contexts[:, None] * SYMBOLS + np.arange(SYMBOLS)[None, :]).ravel()
        base = shorter[code % SYMBOLS**k] if k else shorter[code]
        for lang, tree in enumerate(trees):
            own, count = tree[k]
            at = np.searchsorted(contexts, own // SYMBOLS)
            total = np.bincount(at, weights=count, minlength=len(contexts))
            kinds = np.bincount(at, minlength=len(contexts))
            escape = np.zeros(len(contexts))
            met = kinds > 0
            escape[met] = -np.log2(kinds[met] / (total + kinds)[met])
            out[:, lang] = np.repeat(escape, SYMBOLS) + base[:, lang]
            out[at * SYMBOLS + own % SYMBOLS, lang] = -np.log2(count / (total + kinds)[at])
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language."""
        code, at = coded(texts, self.table)
        out = np.zeros((len(texts), len(self.langs)))
        if not len(code) or not self.langs:
            return out
        code = code.astype(np.int64)
        row = self.row[code // SYMBOLS].astype(np.int64)
        cost = self.seen[row * SYMBOLS + code % SYMBOLS] if len(self.seen) else np.empty((len(code), len(self.langs)), dtype=np.float32)
        new = np.flatnonzero(row < 0)
        cost[new] = self.low[code[new] % SYMBOLS**ORDER]
        full = np.flatnonzero(np.diff(at))
        out[full] = np.add.reduceat(cost, at[full], axis=0, dtype=np.float64)
        return out


def has_letter(t: bytes) -> bool:
    return any(65 <= b <= 90 or 97 <= b <= 122 for b in t[:64]) or any(x.isalpha() for x in t.decode("utf-8", "replace"))


class LanguageId:
    """Fit once from a bounded sample, applied in map tasks; what is broadcast are the counts. A worker makes the tables from them once and drops them with the broadcast."""

    def __init__(self, table: np.ndarray, langs: list[str], trees: list):
        self.table, self.langs, self.trees, self._model = table, langs, trees, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_model": None}

    def model(self) -> Model:
        if self._model is None:
            self._model = Model(self.table, self.langs, self.trees)
        return self._model

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        """Language and its share of probability, all languages equally likely beforehand."""
        texts = [t or b"" for t in texts]
        bits = self.model().bits(texts)
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        best = bits.argmin(axis=1)
        score = 1 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1)
        known = [has_letter(t) for t in texts]
        return [self.langs[i] if k else "und" for i, k in zip(best, known, strict=True)], [float(s) if k else 0.0 for s, k in zip(score, known, strict=True)]


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, lang: str = "lang", text: str = "text", id: str = "doc_id") -> LanguageId:
    """Count the trees on whole texts of at most per_language ids a language, by a hash of the id.

    The bound holds for fitting only. Rows without a language, text or id are not learnt from. Only counts reach the driver.
    """
    from pyspark.sql import Window

    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(id).isNotNull()).select(F.col(lang).alias("lang"), F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(id), F.lit(11)).alias("h"))
    total = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    # a share of each language first, so that the window sorts a bounded number of ids
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, 2 * per_language / n))) for k, n in total.items()], F.lit(1.0)) if total else F.lit(1.0)
    some = rows.select("lang", "id", "h").where((F.pmod("h", F.lit(1_000_003)) / 1_000_003) < share).distinct()
    chosen = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("rank") <= per_language).select("lang", "id")
    chosen = c.checkpointed(chosen)
    source = rows.select("lang", "id", "text").join(F.broadcast(chosen), ["lang", "id"]).select("lang", "text")
    langs = sorted(total)

    def byte_counts(batches):
        n = np.zeros(256, dtype=np.int64)
        for b in batches:
            for part in c.slices(b):
                n += np.bincount(np.frombuffer(b"".join(c.binary(part.column("text"))), dtype=np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(n)], names=["b", "n"])

    count = np.zeros(256, dtype=np.int64)
    for b, n in source.select("text").mapInArrow(c.lean(byte_counts), "b int, n long").groupBy("b").agg(F.sum("n")).collect():
        count[c.LOWER[b]] += n
    common = np.zeros(256, dtype=np.uint32)
    best = np.lexsort((np.arange(256), -count))[: SYMBOLS - 1]
    best = best[count[best] > 0]
    common[best] = np.arange(1, len(best) + 1)
    table = common[c.LOWER]

    def tree(batches):
        for b in batches:
            l, t = np.array(b.column("lang").to_pylist(), dtype=object), c.binary(b.column("text"))
            for name in sorted(set(l)):
                own = [t[i] for i in np.flatnonzero(l == name)]
                for lo, hi in c.pieces(own, 1 << 21):
                    codes, n = np.unique(coded(own[lo:hi], table)[0].astype(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes)), pa.array(codes), pa.array(n, pa.int64())], names=["lang", "code", "n"])

    grown = source.mapInArrow(c.lean(tree), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    of, codes, many = np.array(grown.column("lang").to_pylist(), dtype=object), grown.column("code").to_numpy(), grown.column("n").to_numpy().astype(np.float64)
    trees = []
    for name in langs:
        own = np.flatnonzero(of == name)
        code, n = codes[own], many[own]
        levels = []
        for k in range(ORDER + 1):  # counts of shorter contexts are sums over the longer ones
            low, back = np.unique(code % SYMBOLS ** (k + 1), return_inverse=True)
            levels.append((low, np.bincount(back, weights=n, minlength=len(low)) if len(low) else n))
        trees.append(levels)
    return LanguageId(table, langs, trees)


def identify(docs: DataFrame, model: LanguageId, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' id and text columns to (doc_id, lang_pred, score), a row for each row.

    lang_pred is und with score 0 where the text is null or has no letter, or
    no language was learnt; ties go to the first language by name. Only the
    two named columns are read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for batch in batches:
            for part in c.slices(batch):
                lang, score = predicted(held.value, c.binary(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(c.lean(rows), "doc_id long, lang_pred string, score double")


def predicted(model: LanguageId, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
    lang, score = [], []
    for lo, hi in c.pieces(texts):
        a, b = model.predict(texts[lo:hi])
        lang += a
        score += b
    return lang, score


def identified(docs: DataFrame, model: LanguageId, at_least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs whose language is known: not und, and with a score of at_least. Null and empty texts go; all columns stay."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for batch in batches:
            for part in c.slices(batch):
                keep = [x != "und" and s >= at_least for x, s in zip(*predicted(held.value, c.binary(part.column(text))), strict=True)]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(c.lean(rows), docs.schema)
