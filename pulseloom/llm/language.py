"""Languages of documents and of the parts of mixed ones, by error-correcting output codes.

Each language has a codeword of 15 bits from the simplex code, so any two differ in 8 bits. For each bit a binary
n-gram classifier tells the languages with a 1 from those with a 0: its weights are log-odds of hashed character
n-grams, from counts that Spark takes over a bounded sample of labelled rows. The counts are taken twice: labels may
be wrong and texts mixed, so the second time every sentence counts for the language that the first classifiers give
it. Decoding adds up the bits' logistic losses, weighted by each bit's reliability, and takes the nearest codeword;
the share that the best codeword has of all, given their losses, is the confidence, and a small one flags ambiguity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseloom.functions.common import quoted

# ISO 639 codes and English names of the languages that are told apart.
LANGUAGES = ["de", "en", "es", "fr", "it", "ja", "nl", "pl", "pt", "ru", "sv"]
OTHER_NAMES = {
    "deu": "de", "ger": "de", "german": "de",
    "eng": "en", "english": "en",
    "spa": "es", "spanish": "es",
    "fra": "fr", "fre": "fr", "french": "fr",
    "ita": "it", "italian": "it",
    "jpn": "ja", "japanese": "ja",
    "nld": "nl", "dut": "nl", "dutch": "nl",
    "pol": "pl", "polish": "pl",
    "por": "pt", "portuguese": "pt",
    "rus": "ru", "russian": "ru",
    "swe": "sv", "swedish": "sv",
}

BITS = 15
#: +1/-1 codewords: bit j of language i is the parity of the bits that i + 1 and j + 1 share.
CODEWORDS = np.array([[1 - 2 * ((i & j).bit_count() % 2) for j in range(1, BITS + 1)] for i in range(1, len(LANGUAGES) + 1)])

BUCKETS = 1 << 15
NGRAMS = (1, 2, 3, 4)
#: Labelled rows from which the classifiers are fitted, at most (about: rows are taken by the hash of their id).
SAMPLE_ROWS = 12_000
#: Letters from which a sentence is decoded by itself; shorter ones join the sentence before them.
SENTENCE_LETTERS = 16
#: Confidence under which a part is ambiguous; it then joins its neighbour.
SURE = 0.8

_END = 10  # line feed: separates parts in the code point arrays


def named_language(label: Column) -> Column:
    """The two-letter code that a label names: a code of two or three letters, a locale or an English name; else null."""
    word = F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]+)(?:[-_][A-Za-z0-9]+)*(?:\.[A-Za-z0-9-]+)?$", 1))
    names = F.create_map(*(F.lit(x) for pair in ({c: c for c in LANGUAGES} | OTHER_NAMES).items() for x in pair))
    return F.try_element_at(names, word)


_HEADER_LINE = re.compile(r"^(?:commit [0-9a-f]{7,}|[A-Z][A-Za-z-]*: )")
_TRAILER = re.compile(r"^(?:[A-Z][A-Za-z]*(?:-[A-Za-z]+)*: \S.*|\((?:cherry )?picked .*\)?)$")
_NOT_PROSE = re.compile(r"\b\w+\([^)\s]*\)!?:|[!-~]*[/_\\@<>{}=0-9][!-~]*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
_MOJIBAKE = re.compile(r"[ÂÃÄÅÐÑâãäåæçèé][\x80-\xbfŒ-™]")


def message_of(text: str) -> list[tuple[bool, str]]:
    """The message's lines as (quoted?, line), blank lines included, without header, trailers, comments and diffs."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    cut = re.search(r"(?m)^diff --git ", text)
    if cut:
        text = text[: cut.start()]
    lines = text.split("\n")
    body: list[str] = []
    i, mail = 0, lines[0].startswith("From: ") or lines[0].startswith("From ")
    if mail or lines[0].startswith("commit "):
        while i < len(lines) and lines[i].strip():
            if mail and lines[i].startswith("Subject:"):
                body.append(re.sub(r"^Subject:\s*(?:\[PATCH[^\]]*\]\s*)?", "", lines[i]))
                while i + 1 < len(lines) and lines[i + 1].startswith((" ", "\t")) and lines[i + 1].strip():
                    i += 1
                    body.append(lines[i])
            i += 1
        body.append("")
    out: list[tuple[bool, str]] = []
    for line in [*body, *lines[i:]]:
        line = line.strip()
        if line == "---":
            if mail:
                break
            continue
        if _TRAILER.match(line) or line.startswith("#"):
            continue
        is_quote = line.startswith(">")
        out.append((is_quote, line.lstrip("> ") if is_quote else line))
    return out


def _mend(text: str) -> str:
    """Undo UTF-8 read as a one-byte encoding, where that gives valid text."""
    if _MOJIBAKE.search(text):
        for encoding in ("cp1252", "latin-1"):
            try:
                return text.encode(encoding).decode("utf-8")
            except UnicodeError:
                continue
        pieces = re.split(r"([\x80-\xffŒ-™]{2,})", text)
        for k in range(1, len(pieces), 2):
            try:
                pieces[k] = pieces[k].encode("cp1252").decode("utf-8")
            except UnicodeError:
                continue
        return "".join(pieces)
    return text


def letters(text: str) -> int:
    return sum(map(str.isalpha, text))


def sentences_of(lines: list[tuple[bool, str]]) -> list[str]:
    """Sentences of a message; wrapped lines are joined, a blank line or the edge of a quotation ends one."""
    blocks: list[list[str]] = [[]]
    was = False
    for is_quote, line in lines:
        if not line or is_quote != was:
            blocks.append([])
        was = is_quote
        if line:
            blocks[-1].append(line)
    out: list[str] = []
    for block in blocks:
        for sentence in _SENTENCE.split(_mend(" ".join(block))) if block else ():
            prose = " ".join(_NOT_PROSE.sub(" ", sentence).lower().split())
            if not prose:
                continue
            if out and letters(prose) < _least(prose):
                out[-1] += " " + prose
            else:
                out.append(prose)
    if len(out) > 1 and letters(out[0]) < _least(out[0]):
        out[1] = f"{out[0]} {out[1]}"
        del out[0]
    return out


def _least(prose: str) -> int:
    return SENTENCE_LETTERS // 4 if any(c >= "぀" for c in prose) else SENTENCE_LETTERS


def ngrams(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, part number) of every character n-gram; each part is padded with blanks."""
    points = np.frombuffer("".join(f" {p} \n" for p in parts).encode("utf-32-le", "replace"), np.uint32)
    owner = np.cumsum(points == _END) - (points == _END)
    buckets, owners = [], []
    for n in NGRAMS:
        length = len(points) - n + 1
        if length <= 0:
            continue
        key, whole = np.full(length, n, np.uint64), np.ones(length, bool)
        for k in range(n):
            point = points[k : k + length]
            whole &= point != _END
            key = (key * np.uint64(1_000_003)) ^ point
        key = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
        buckets.append(key[whole].astype(np.int64))
        owners.append(owner[:length][whole])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    """Weights of the bits' classifiers by n-gram bucket, and the bits' reliabilities."""

    weights: np.ndarray
    reliability: np.ndarray

    def decode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(language number, confidence) of each part."""
        best, sure = np.zeros(len(parts), np.int64), np.zeros(len(parts))
        for start, stop in _slices(parts):
            bucket, owner = ngrams(parts[start:stop])
            k = stop - start
            margin = np.stack([np.bincount(owner, self.weights[:, j][bucket], k) for j in range(BITS)], axis=1)
            margin /= np.sqrt(np.maximum(np.bincount(owner, minlength=k), 1))[:, None]
            loss = np.stack([np.logaddexp(0, -margin * word) @ self.reliability for word in CODEWORDS], axis=1)
            best[start:stop] = loss.argmin(1)
            sure[start:stop] = 1 / np.exp(np.minimum(loss.min(1, keepdims=True) - loss, 0)).sum(1)
        return best, sure


def _slices(parts: list[str], characters: int = 100_000) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, part in enumerate(parts):
        held += len(part)
        if held > characters:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(parts):
        yield start, len(parts)


def model_from_counts(counts: np.ndarray) -> Model:
    """Bit classifiers from n-gram counts by language and bucket; languages count alike, whatever their share."""
    seen = counts.sum(1) > 0
    share = (counts + 0.05) / (counts + 0.05).sum(1, keepdims=True)
    weights, reliability = np.zeros((BUCKETS, BITS)), np.ones(BITS)
    for j in range(BITS):
        one, zero = seen & (CODEWORDS[:, j] > 0), seen & (CODEWORDS[:, j] < 0)
        if one.any() and zero.any():
            weights[:, j] = np.log(share[one].mean(0)) - np.log(share[zero].mean(0))
            # expected share of a language's n-grams that vote for its side
            right = [(share[i] * (weights[:, j] * CODEWORDS[i, j] > 0)).sum() for i in np.flatnonzero(seen)]
            reliability[j] = max(1e-3, 2 * float(np.mean(right)) - 1)
        else:
            reliability[j] = 0.0
    return Model(weights, reliability / max(reliability.max(), 1e-9))


def _count(sample: DataFrame, model: Model | None) -> np.ndarray:
    """N-gram counts by language; with a model its sentences' languages count, else the labels."""
    number = {c: i for i, c in enumerate(LANGUAGES)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(LANGUAGES) * BUCKETS, np.int64)
        for batch in batches:
            parts, own = [], []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                found = sentences_of(message_of(text))
                parts += found
                own += [number[label]] * len(found)
            if not parts:
                continue
            languages = np.array(own)
            if model is not None:
                languages, sure = model.decode(parts)
                parts = [p for p, s in zip(parts, sure, strict=True) if s > 0.9]
                languages = languages[sure > 0.9]
            for start, stop in _slices(parts):
                bucket, owner = ngrams(parts[start:stop])
                np.add.at(total, languages[start:stop][owner] * BUCKETS + bucket, 1)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["at", "n"])

    rows = sample.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most languages x buckets
    counts = np.zeros(len(LANGUAGES) * BUCKETS)
    counts[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return counts.reshape(len(LANGUAGES), BUCKETS)


def fit(df: DataFrame, doc_id: str, text: str, label: str, *, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit the bit classifiers on about ``sample_rows`` of the rows whose label names a language, chosen by hash of id."""
    labelled = df.select(quoted(doc_id).alias("id"), quoted(text).alias("text"), named_language(quoted(label)).alias("label")).where("label is not null and text is not null")
    n = df.select(named_language(quoted(label)).alias("label")).where("label is not null").count()
    part = 1 << 20
    sample = labelled.where(F.pmod(F.xxhash64("id"), F.lit(part)) < max(1, min(part, part * sample_rows // max(n, 1))))
    sample = sample.select(_head("text").alias("text"), "label")
    return model_from_counts(_count(sample, model_from_counts(_count(sample, None))))


def _head(text: str) -> Column:
    """The text before its diffs, so that these never leave the JVM."""
    return F.substring_index(quoted(text), "\ndiff --git ", 1)


def find_languages(df: DataFrame, doc_id: str, text: str, label: str, *, model: Model | None = None, least_letters: int = 25) -> DataFrame:
    """One row per document and language of its message.

    Columns: the id, ``label`` (language that the given label names, or null), ``n_letters`` of the message, ``lang``,
    ``share`` of the letters, ``confidence``, ``ambiguous``, ``n_languages`` and ``parts``, the message's stretches of
    one language in order as (lang, confidence, n_letters).

    Defined cases: null texts, texts without a message and messages of fewer than ``least_letters`` letters give no
    rows; labels that name no known language are null; a part that is ambiguous or short joins its neighbour, and an
    ambiguous message gets its nearest language with ``ambiguous`` set; repeated rows are judged each; text in a
    language that is not among the known ones gets the nearest of these, mostly as ambiguous; very long messages are
    taken whole; an empty table gives no rows.
    """
    model = model or fit(df, doc_id, text, label)
    rows = df.where(quoted(text).isNotNull()).select(quoted(doc_id).alias("id"), _head(text).alias("text"), named_language(quoted(label)).alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[str] = []
            owner: list[int] = []
            size: dict[int, int] = {}
            for i, value in enumerate(batch.column("text").to_pylist()):
                lines = message_of(value)
                n = letters("".join(line for _, line in lines))
                if n < least_letters:
                    continue
                found = sentences_of(lines)
                size[i] = n
                parts += found
                owner += [i] * len(found)
            if not parts:
                continue
            best, sure = model.decode(parts)
            out: list[tuple] = []
            start = 0
            while start < len(parts):
                stop = start
                while stop < len(parts) and owner[stop] == owner[start]:
                    stop += 1
                stretches = _stretches(best[start:stop], sure[start:stop], parts[start:stop])
                shares: dict[int, list[float]] = {}
                for language, confidence, n in stretches:
                    got = shares.setdefault(language, [0, 0.0])
                    got[0] += n
                    got[1] += n * confidence
                total = max(1, sum(n for n, _ in shares.values()))
                told = [{"lang": LANGUAGES[lang], "confidence": c, "n_letters": n} for lang, c, n in stretches]
                for language, (n, weighted) in shares.items():
                    confidence = weighted / max(n, 1)
                    out.append((owner[start], size[owner[start]], LANGUAGES[language], n / total, confidence, confidence < SURE, len(shares), told))
                start = stop
            columns = list(zip(*out, strict=True))
            which = pa.array(columns[0])
            kinds = (pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.int32(), pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("n_letters", pa.int32())])))
            yield pa.record_batch(
                [batch.column("id").take(which), batch.column("label").take(which), *(pa.array(c, kind) for c, kind in zip(columns[1:], kinds, strict=True))],
                names=["id", "label", "n_letters", "lang", "share", "confidence", "ambiguous", "n_languages", "parts"],
            )

    schema = f"id {rows.schema['id'].dataType.simpleString()}, label string, n_letters int, lang string, share double, confidence double, ambiguous boolean, n_languages int, parts array<struct<lang:string,confidence:double,n_letters:int>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", doc_id)


def _stretches(best: np.ndarray, sure: np.ndarray, parts: list[str]) -> list[tuple[int, float, int]]:
    """Stretches of one language as (language, confidence, letters); unsure sentences join the neighbour they fit."""
    language = best.copy()
    certain = sure >= SURE
    if certain.any():
        for i in np.flatnonzero(~certain):
            near = np.flatnonzero(certain)
            language[i] = best[near[np.argmin(np.abs(near - i))]]
    else:
        language[:] = best[np.argmax(sure)]
    out: list[tuple[int, float, int]] = []
    for i, part in enumerate(parts):
        n, confidence = letters(part), float(sure[i]) if language[i] == best[i] else 1 - float(sure[i])
        if out and out[-1][0] == language[i]:
            before = out[-1]
            out[-1] = (before[0], (before[1] * before[2] + confidence * n) / max(1, before[2] + n), before[2] + n)
        else:
            out.append((int(language[i]), confidence, n))
    return out
