"""Language identification in two levels: first the family, then one-versus-one linear support vector machines.

Features are hashed byte trigrams of the lower-cased text, blanks for all that is
not a letter; a text's value under a linear machine is the mean weight of its
trigrams. One machine per pair of families votes on the family, one per pair of
languages inside it votes on the language. Machines are fitted one a task, each
from at most `per_language` labelled texts a side; the driver gathers only their
weights. Every text is then judged whole, inside its own row, without a shuffle.

Defined results: a null text, or one without any letter, is `und` with score 0.
Ties between votes go to the larger sum of margins, then to the first name in
alphabetical order. With one learned language all texts get it with score 1;
with none, all are `und` with score 0. Repeated rows each get their own result;
other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternqa.llm import words as W
from lanternqa.llm.scratch import Scratch

UNKNOWN = "und"
BINS = 1 << 13
PER_LANGUAGE = 1000

# Families of some languages by ISO 639-1 code. Any other language is a family of its own.
FAMILIES = {
    "germanic": "af da de en is lb nl no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "turkic": "az kk ky tr tt uz",
    "uralic": "et fi hu",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
}


def family_of(language: str) -> str:
    return next((name for name, codes in FAMILIES.items() if language in codes.split()), language)


def _letters() -> np.ndarray:
    """Lower-cased letters and all bytes of other scripts; blanks for the rest."""
    table = np.full(256, 32, np.uint8)
    table[0x61:0x7B] = np.arange(0x61, 0x7B)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    table[0x80:] = np.arange(0x80, 0x100)
    return table


def trigram_bins(texts: list[bytes], bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """The bin of every byte trigram of some texts, and each text's first trigram (one more at the end).

    Each text stands between blanks. Trigrams of blanks alone have bin 0, which carries no weight.
    """
    data = _letters()[np.frombuffer(b" " + b"  ".join(texts) + b"  ", np.uint8)]
    offset = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 2 for x in texts], out=offset[1:])
    x = data.astype(np.uint32)
    x = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    spread = (x * np.uint32(0x9E3779B1)) >> np.uint32(32 - int(bins).bit_length() + 1)
    spread[x == 0x202020] = 0
    return spread[: offset[-1]].astype(np.int32), offset


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _vectors(batches: Iterable[pa.RecordBatch], bins: int) -> Iterator[pa.RecordBatch]:
    """Each labelled text as the sparse means of its trigram bins; copies inside a task once."""
    seen = set()
    for batch, texts in W.chunks(batches):
        fresh = []
        for i, mark in enumerate(zip(batch.column("lang").to_pylist(), batch.column("key").to_pylist())):
            if mark not in seen:
                seen.add(mark)
                fresh.append(i)
        batch, texts = batch.take(pa.array(fresh, pa.int64())), [texts[i] for i in fresh]
        found, offset = trigram_bins([x or b"" for x in texts], bins)
        places, values = [], []
        for a, b in zip(offset[:-1], offset[1:]):
            place, count = np.unique(found[a:b], return_counts=True)
            places.append(place.astype("<u2").tobytes())
            values.append((count / max(1, b - a)).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("key"), pa.array(places, pa.binary()), pa.array(values, pa.binary())],
            names=["lang", "key", "places", "shares"],
        )


@dataclass
class Machine:
    """Separates two names: a positive margin is for `yes`."""

    yes: str
    no: str
    weights: np.ndarray
    bias: float


@dataclass
class LanguageModel:
    languages: list[str]
    families: list[Machine] = field(default_factory=list)
    within: dict[str, list[Machine]] = field(default_factory=dict)
    bins: int = BINS


def fit_machine(
    yes: str, no: str, x: np.ndarray, y: np.ndarray, rounds: int = 300, strength: float = 1e-4
) -> Machine:
    """A linear support vector machine with squared hinge loss, by full-batch accelerated descent.

    Both sides weigh the same however many rows they have. Features are scaled
    to a common spread for the fit, in place, and the scale is folded into the
    weights.
    """
    scale = (1.0 / (x.std(0) + 1e-4)).astype(np.float32)
    scale[0] = 0.0
    z = np.multiply(x, scale, out=x)
    center = z.mean(0)
    z -= center
    side = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum())).astype(np.float32)
    sign = np.where(y, 1.0, -1.0).astype(np.float32)
    step = 1.0 / (2.0 * float((side * np.einsum("ij,ij->i", z, z)).sum()) + strength)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    ahead, bias_ahead = w, b
    for t in range(rounds):
        gap = np.maximum(0, 1 - sign * (z @ ahead + bias_ahead)) * sign * side
        new = ahead + 2 * step * (gap @ z) - step * strength * ahead
        bias = bias_ahead + 2 * step * float(gap.sum())
        pull = t / (t + 3)
        ahead, bias_ahead = new + pull * (new - w), bias + pull * (bias - b)
        w, b = new, bias
    return Machine(yes, no, (w * scale).astype(np.float32), float(b - center @ w))


def _up_to(rows: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The rows whose key is at most their language's limit; there is a limit a language, so they are few."""
    table = rows.sparkSession.createDataFrame(sorted(limits.items()), "lang string, _limit long")
    return rows.join(F.broadcast(table), "lang").filter("key <= _limit").drop("_limit")


def key_limits(rows: DataFrame, per_language: int, max_languages: int | None = None) -> dict[str, int]:
    """The `per_language`-th smallest distinct key of each language of (lang, key) rows, or its largest if it has fewer.

    Copies fold before anything is counted. Keys are even, so a threshold leaves a little more than what is wanted;
    where it leaves less, it is raised.
    """
    scratch = Scratch(rows.sparkSession)
    keys = scratch.write(rows.select("lang", "key").distinct(), "keys")
    counts = {r["lang"]: r["count"] for r in keys.groupBy("lang").count().collect()}
    if max_languages is not None and len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    limits: dict[str, int] = {}
    spare = 100 + 10 * per_language**0.5
    while len(limits) < len(counts):
        shares = {lang: min(1.0, (per_language + spare) / n) for lang, n in counts.items() if lang not in limits}
        tried = {lang: min(int(share * (1 << 64)) - (1 << 63), (1 << 63) - 1) for lang, share in shares.items()}
        found: dict[str, list[int]] = {lang: [] for lang in tried}
        for r in _up_to(keys, tried).collect():
            found[r["lang"]].append(r["key"])
        for lang, own in found.items():
            wanted = min(per_language, counts[lang])
            if len(own) >= wanted:
                limits[lang] = sorted(own)[wanted - 1]
        spare *= 4
    scratch.drop("keys")
    return limits


def _fit(rows: pa.Table, bins: int, per_language: int) -> pa.Table:
    """Fit one machine on its (side, languages of that side, key, lang, places, shares) rows.

    A side takes the same number of texts of each of its languages, those with
    the smallest keys, and at most `per_language` in all.
    """
    held = sorted(rows.to_pylist(), key=lambda r: (r["side"], r["lang"], r["key"]))
    vectors, yes, taken = [], [], {}
    for r in held:
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] > max(1, per_language // r["share"]):
            continue
        vector = np.zeros(bins, np.float32)
        vector[np.frombuffer(r["places"], "<u2")] = np.frombuffer(r["shares"], "<f4")
        vectors.append(vector)
        yes.append(r["side"] == 0)
    machine = fit_machine("", "", np.array(vectors), np.array(yes))
    columns = [pa.array([held[0]["machine"]], pa.int32()), pa.array([machine.weights.tobytes()]), pa.array([machine.bias])]
    return pa.Table.from_arrays(columns, names=["machine", "weights", "bias"])


def fit_languages(
    labelled: DataFrame, per_language: int = PER_LANGUAGE, bins: int = BINS, max_languages: int | None = None
) -> LanguageModel:
    """Fit on (text, lang) rows: the `per_language` distinct texts of each language with the smallest keys, or all.

    One machine is one task, on at most `per_language` texts a side. Only the
    weights, and the languages with a key each, come to the driver. Machines
    grow with the square of a family's languages and of the families, as
    one-versus-one asks; `max_languages` makes more languages than that an error.
    """
    rows = labelled.select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("text").cast("string")).alias("key"),
    ).filter("text IS NOT NULL AND lang IS NOT NULL")
    limits = key_limits(rows, per_language, max_languages)
    model = LanguageModel(sorted(limits), bins=bins)
    groups: dict[str, list[str]] = {}
    for lang in model.languages:
        groups.setdefault(family_of(lang), []).append(lang)
    pairs = [(None, a, b, groups[a], groups[b]) for a, b in combinations(sorted(groups), 2)]
    for name, langs in groups.items():
        model.within[name] = []
        pairs += [(name, a, b, [a], [b]) for a, b in combinations(langs, 2)]
    if not pairs:
        return model
    spark, scratch = labelled.sparkSession, Scratch(labelled.sparkSession)
    vectors = _up_to(rows, limits).mapInArrow(
        lambda batches: _vectors(batches, bins), "lang string, key long, places binary, shares binary"
    )
    sample = scratch.write(vectors.dropDuplicates(["lang", "key"]), "sample")
    sides = [
        (k, side, len(langs), lang)
        for k, pair in enumerate(pairs) for side, langs in enumerate(pair[3:]) for lang in langs
    ]
    wanted = spark.createDataFrame(sides, "machine int, side int, share int, lang string")
    fitted = (
        sample.join(F.broadcast(wanted), "lang").repartition(len(pairs), "machine").groupBy("machine")
        .applyInArrow(lambda table: _fit(table, bins, per_language), "machine int, weights binary, bias double")
    )
    found = {r["machine"]: (np.frombuffer(r["weights"], np.float32), r["bias"]) for r in fitted.collect()}
    scratch.drop("sample")
    for k, (name, yes, no, *_) in enumerate(pairs):
        (model.families if name is None else model.within[name]).append(Machine(yes, no, *found[k]))
    return model


def _vote(machines: list[Machine], margins: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The winner's index among `names` for each column of margins, and how sure its closest contest is."""
    n = margins.shape[1] if machines else 0
    votes, sums = np.zeros((len(names), n)), np.zeros((len(names), n))
    sure = np.full((len(names), n), np.inf)
    for machine, margin in zip(machines, margins):
        for name, m in ((machine.yes, margin), (machine.no, -margin)):
            k = names.index(name)
            votes[k] += m > 0
            sums[k] += m
            sure[k] = np.minimum(sure[k], m)
    best = np.lexsort((np.broadcast_to(-np.arange(len(names))[:, None], votes.shape), sums, votes), axis=0)[-1]
    return best, 1 / (1 + np.exp(-np.clip(2 * sure[best, np.arange(n)], -60, 60)))


def _predict(texts: list[bytes], model: LanguageModel) -> tuple[list[str], list[float]]:
    """The language of each text and its score: the product of both levels' closest contests."""
    found, offset = trigram_bins(texts, model.bins)
    lengths = np.diff(offset)

    def margins(machines: list[Machine]) -> np.ndarray:
        out = np.empty((len(machines), len(texts)))
        for k, machine in enumerate(machines):
            out[k] = np.add.reduceat(machine.weights[found], offset[:-1], dtype=np.float64) / lengths + machine.bias
        return out

    groups: dict[str, list[str]] = {}
    for lang in model.languages:
        groups.setdefault(family_of(lang), []).append(lang)
    names = sorted(groups)
    family, score = np.zeros(len(texts), int), np.ones(len(texts))
    if len(names) > 1:
        family, score = _vote(model.families, margins(model.families), names)
    out = [""] * len(texts)
    for k, name in enumerate(names):
        rows = np.flatnonzero(family == k)
        langs, machines = groups[name], model.within[name]
        if len(langs) > 1:
            best, sure = _vote(machines, margins(machines)[:, rows], langs)
            score[rows] *= sure
        else:
            best = np.zeros(len(rows), int)
        for row, b in zip(rows.tolist(), best.tolist()):
            out[row] = langs[b]
    for i, text in enumerate(texts):
        if not model.languages or not _letter_known(text):
            out[i], score[i] = UNKNOWN, 0.0
    return out, score.tolist()


def _letter_known(text: bytes) -> bool:
    """Whether the text has a letter; ASCII letters settle nearly all texts at once."""
    return text[:64].lower() != text[:64].upper() or _has_letter(text)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) of every text."""

    def work(batches):
        for batch, texts in W.chunks(batches, 1 << 20):
            langs, scores = _predict([x or b"" for x in texts], model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, languages: list[str] | None = None) -> DataFrame:
    """The rows of `docs` whose text has a language (one of `languages`, if given), unchanged.

    A model that has learned no language rejects only texts without a letter.
    """

    def work(batches):
        for batch in batches:
            for piece, texts in W.chunks([batch], 1 << 20):
                if not model.languages:
                    yield piece.filter(pa.array([_letter_known(x or b"") for x in texts], pa.bool_()))
                    continue
                langs, _ = _predict([x or b"" for x in texts], model)
                keep = [x != UNKNOWN and (languages is None or x in languages) for x in langs]
                yield piece.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
