"""Secret scans: fixed patterns, and strings that a primed zstandard compressor finds novel.

Base kinds (spans in code points, end exclusive, leftmost non-overlapping for each kind): `assign`, `access`, `hex`.
They always stay.

Kind `novel`: every string of MIN_NOVEL characters or more in a sensitive context - within REACH characters before or
after a sensitive word, values of `assign` included - is measured. Its cost is its marginal compressed bytes: how much
its surroundings (AROUND characters on either side, without repeats of the string itself) grow when it is appended. The
compressor is primed with a dictionary trained on identifiers, so known identifiers cost few bytes, unknown words of
letters cost what letters cost, and random strings cost their whole length. A string is reported where its cost for a
character reaches a threshold that is calibrated on planted random strings and on identifiers kept out of the training.

The identifiers are a fixed list and those of the corpus: words of letters and underscores in the surroundings of
sensitive words, counted by distinct texts over all documents; the DICTIONARY_WORDS most frequent of those in
MIN_TEXTS texts or more go to the driver (at most 25 bytes each), which is the dictionary's bound.

Defined results: a null text is the empty text; a text without spans has the digest of the empty string; repeated rows
each have their row; a null id keeps its row; texts of any length are scanned whole; other columns, whatever their
names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathfold.llm.workers import tidied

KINDS = ("assign", "access", "hex", "novel")
MIN_VALUE, MIN_ACCESS, MIN_HEX, MIN_NOVEL = 6, 20, 24, 12
#: Characters on either side of a sensitive word in which a candidate begins or ends, and characters of surroundings.
REACH, AROUND = 80, 160
#: The dictionary: words from the corpus at most, texts that must hold a word, bytes.
DICTIONARY_WORDS, MIN_TEXTS, DICTIONARY_BYTES = 4096, 3, 16_384
LEVEL = 3

ASSIGN = re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
SENSITIVE = re.compile(r"(?i:password|passwd|secret|token|api_?key|private_?key|access_?key|credential|bearer|authorization)", re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z_]{3,24}(?![A-Za-z0-9+/=_-])")
_BASE_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_MORE_WORDS = ("private", "access", "credential", "bearer", "authorization")
_HEX_TABLE = bytes(1 if chr(i) in "0123456789abcdef" else 0 for i in range(256))

#: Fixed value: identifiers that are ordinary near sensitive words.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key public_key credential credentials bearer authorization "
    "authentication authenticate authorized username user_name user_id account session session_id request response header "
    "headers content_type application json config configuration settings environment variable default example placeholder "
    "change_me your_token_here your_api_key insert_key_here process env getenv environ string value client_id client_secret "
    "refresh_token access_token id_token csrf_token token_type expires_in expiration timeout connection database host port "
    "server localhost endpoint https http www com org import from return function class public static final void const let "
    "var null None True False self this new delete update insert select create table index length count number result error "
    "exception message status code data input output file path name type key keys encode decode encrypt decrypt hash digest "
    "sha256 base64 utf8 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 xxxxxxxxxxxxxxxx"
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns. Cheap tests on the whole text come before each pattern."""
    spans: list[tuple[int, int, str]] = []
    low = text.lower()
    if any(w in low for w in _BASE_WORDS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_VALUE]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    if b"\1" * MIN_HEX in text.encode("utf-8", "surrogatepass").translate(_HEX_TABLE):
        spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return spans


def sensitive_words(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sensitive words; a cheap test on the whole text comes first."""
    low = text.lower()
    return [m.span() for m in SENSITIVE.finditer(text)] if any(w in low for w in _BASE_WORDS + _MORE_WORDS) else []


def identifiers_near(text: str) -> set[str]:
    """The identifiers in the surroundings of a text's sensitive words."""
    found: set[str] = set()
    for s, e in sensitive_words(text):
        found.update(IDENTIFIER.findall(text[max(0, s - AROUND) : s]))
        found.update(IDENTIFIER.findall(text[e : e + AROUND]))
    return found


def corpus_identifiers(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY_WORDS, texts: int = MIN_TEXTS) -> list[str]:
    """The most frequent identifiers in sensitive surroundings, by distinct texts, over all documents; ties by word."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            words, marks = [], []
            for text, mark in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                near = identifiers_near(text.as_py() or "")
                words += near
                marks += [mark] * len(near)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(marks, pa.int64())], names=["word", "mark"])

    near = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("mark")).mapInArrow(tidied(run), "word string, mark long")
    counted = near.distinct().groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= texts)
    return [r[0] for r in counted.orderBy(F.desc("n"), "word").limit(most).collect()]


@dataclass
class Novelty:
    """Marginal compressed bytes of strings, by a compressor primed with identifiers, and the threshold for a character."""

    dictionary: bytes
    threshold: float = 1.0
    _made: dict = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def fitted(cls, words: list[str] = (), seed: int = 11) -> Novelty:
        """Trained on four fifths of the fixed identifiers and of `words`, calibrated on the rest and on random strings."""
        import zstandard

        r = random.Random(seed)
        known = sorted({*IDENTIFIERS.split(), *words})
        held, own = known[::5], [w for i, w in enumerate(known) if i % 5]
        samples = [" ".join(r.choice(own) for _ in range(20)).encode() for _ in range(max(400, len(own) // 5))]
        out = cls(zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes())

        def planted(random_: bool) -> float:
            size, chars = r.randint(MIN_NOVEL, 40), r.choice(("0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"))
            joiner, value = r.choice(("_", "-", "")), ""
            if random_:
                value = "".join(r.choice(chars) for _ in range(size))
            while len(value) < size:
                value += (joiner if value else "") + r.choice((r.choice(held), r.choice(own)))
            return out.marginal(r.choice(own) + " " + r.choice(own) + ' = "', value, '" ' + r.choice(own)) / len(value)

        secret, plain = sorted(planted(True) for _ in range(600)), sorted(planted(False) for _ in range(600))
        # The threshold is in the middle of the costs that tell the two apart best.
        cuts = sorted({*secret, *plain})
        right = [sum(x >= c for x in secret) + sum(x < c for x in plain) for c in cuts]
        best = [i for i, n in enumerate(right) if n == max(right)]
        out.threshold = (cuts[best[0] - 1] if best[0] else 0.0) / 2 + cuts[best[-1]] / 2
        return out

    @property
    def compressor(self):
        import zstandard

        if "it" not in self._made:
            primer = zstandard.ZstdCompressionDict(self.dictionary)
            self._made["it"] = zstandard.ZstdCompressor(level=LEVEL, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False)
        return self._made["it"]

    def __getstate__(self) -> tuple:
        return self.dictionary, self.threshold

    def __setstate__(self, state: tuple) -> None:
        self.dictionary, self.threshold = state
        self._made = {}

    def marginal(self, before: str, candidate: str, after: str) -> int:
        around = (before.replace(candidate, "") + after.replace(candidate, "") + "\n").encode("utf-8", "surrogatepass")
        with_it = around + candidate.encode("utf-8", "surrogatepass")
        return len(self.compressor.compress(with_it)) - len(self.compressor.compress(around))

    def measured(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, marginal bytes) of every candidate in a sensitive context, in order."""
        words = sensitive_words(text)
        if not words:
            return []
        values = [m.span(1) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_NOVEL]
        starts = [a for a, _ in values]
        inside = lambda a, b: (i := bisect_left(starts, b)) and values[i - 1][1] > a
        # Runs are apart and in order, and so are values; a run that meets a value is measured as that value.
        runs = [m.span() for m in CANDIDATE.finditer(text)]
        ends = [b for _, b in runs]
        spans = set(values)
        for s, e in words:
            for i in range(bisect_left(ends, s - REACH), len(runs)):
                a, b = runs[i]
                if a > e + REACH:
                    break
                if not inside(a, b):
                    spans.add((a, b))
        return [(a, b, self.marginal(text[max(0, a - AROUND) : a], text[a:b], text[b : b + AROUND])) for a, b in sorted(spans)]

    def novel(self, measured: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
        return [(a, b, "novel") for a, b, cost in measured if cost >= self.threshold * (b - a)]


def joined(spans: list[tuple[int, int, str]]) -> str:
    order = sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in order)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, n_measured long, novel_bytes long, base_sha256 string, spans string"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", novelty: Novelty | None = None) -> DataFrame:
    """The columns of SCHEMA: spans of each kind, candidates measured, and the bytes that all of these cost. One row for
    each row of the input; no shuffle of texts. `novelty` is fitted on the documents' own identifiers if not given."""
    shared = docs.sparkSession.sparkContext.broadcast(novelty or Novelty.fitted(corpus_identifiers(docs, text_col)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = shared.value
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base, costs = base_spans(text), own.measured(text)
                more = own.novel(costs)
                counts = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
                rows.append((*counts, len(more), len(costs), sum(c for _, _, c in costs), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), SCHEMA)
