"""Garbled text from wrong character encodings (problem 9).

Texts are cut into units: runs without white space that hold a character outside ASCII. A multinomial classifier over hashed byte
bigrams (and the bytes of neighbouring characters) is trained on clean units and on the same units garbled by every known chain of
encodings. It names the likeliest chains of a unit, of those that it holds likelier than that the unit is clean; each is inverted,
checked to decode strictly, and weighed against the unit as it stands by a character model of the whole corpus. What the units of
a text say for one chain adds up, and a text is garbled if that comes to the odds against garbling. Units from which bytes were lost
(replacement characters, or bytes that a decoder dropped) count as garbled though they can't be restored.

Sequences of several bytes that decode strictly count on their own (WIDE_ODDS), however often the garbled form stands in the corpus:
a footer that is garbled in thousands of documents, or a source that is read wrongly throughout, makes its forms frequent, but
does not make them decode. A lone character says less (LONE_ODDS), since many chains make something of it, and nothing at all beside a
word with a character that its decoder can't have made.

The character model comes from the words of all documents, each distinct text once, counted over the cluster; character
pairs and triples are summed per hashed slot, so that what reaches the driver has a fixed size. Counting is done twice, the
second time without the words that the first model finds garbled. The classifier is fitted on the TRAIN_UNITS most frequent units and
TRAIN_RUNS runs of scripts without spaces, its chains shared out over the cluster.

Defined results: null, empty and ASCII texts are not garbled; repeated rows count once; characters that no chain can make
(other scripts, emoji, combining marks) are left alone; whole texts are read; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import codecs
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util import cut

__all__ = ["CHAINS", "garble", "invert", "units", "Model", "train", "garbled_documents", "restored_documents"]

#: The single-byte and multi-byte encodings in common use for the scripts concerned.
SINGLE = ["cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "mac_roman", "cp437", "cp850", "cp852", "cp866"]
WIDE = ["utf-8", "cp932", "euc_jp"]
#: A chain lists (written in, read as) steps, the first mistake first.
CHAINS = [((w, r),) for w in WIDE + SINGLE for r in SINGLE if w != r]
CHAINS += [(("utf-8", a), ("utf-8", b)) for a in ("cp1252", "latin-1") for b in ("cp1252", "latin-1", "mac_roman", "cp437")]
CHAINS += [(("utf-8", a), ("utf-8", a), ("utf-8", a)) for a in ("cp1252", "latin-1")]
BITS = 15
#: Chains tried for a unit, in the classifier's order.
TRIED = 8
#: Log odds that the units of a text must come to: about one text in 150 is taken to be garbled before it is looked at.
ODDS = 5.0
#: Log odds of a unit from which on a chain counts it.
COUNTED = 1.0
#: Log odds in favour of a chain for each sequence of several bytes that decodes, up to WIDE_MOST of them: of the pairs of characters above
#: ASCII that a clean text may hold, about one in sixty is such a sequence.
WIDE_ODDS, WIDE_MOST = 4.0, 4
#: Log odds against a chain of single bytes that has but one lone character to go by.
LONE_ODDS = 2.0
#: In a garbled text a unit is restored if it decodes by one of the text's chains as several bytes, or if its log odds for one come to FOLLOWS;
#: of its chains those count that come within NEAR of the best.
FOLLOWS, NEAR = -3.0, 3.0
#: Words whose log odds come to this are left out of the second count.
LEFT_OUT = 6.0
#: Bounds of the classifier's sample: units, runs of scripts without spaces, and their characters together.
TRAIN_UNITS, TRAIN_RUNS, TRAIN_CHARS = 6_000, 600, 1_000_000
#: Slots of the tables of characters, pairs and triples, as powers of 2.
SLOTS = (18, 20, 22)
LOST = "�"


def _table(name: str) -> str:
    """Decoding table in which bytes without a meaning become the control characters of their number."""
    out = []
    for i in range(256):
        try:
            out.append(bytes([i]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(i))
    return "".join(out)


_READ = {n: _table(n) for n in SINGLE}
_BACK = {n: {ord(c): i for i, c in reversed(list(enumerate(t)))} for n, t in _READ.items()}


def _encode(text: str, name: str) -> bytes | None:
    if name in _BACK:
        raw = text.translate(_BACK[name])
        # a character that has no byte is left as it was; those below 256 need a closer look
        try:
            out = raw.encode("latin-1")
        except UnicodeEncodeError:
            return None
        back = _BACK[name]
        return out if all(ord(c) in back for c in text) else None
    try:
        return text.encode(name)
    except UnicodeEncodeError:
        return None


def _decode(raw: bytes, name: str, errors: str = "strict") -> str | None:
    if name in _READ:
        return codecs.charmap_decode(raw, "strict", _READ[name])[0]
    try:
        return raw.decode(name, errors)
    except UnicodeDecodeError:
        return None


def garble(text: str, chain) -> str | None:
    """The text as it looks after the chain of mistakes, None where an encoding can't write it."""
    for wrote, read in chain:
        raw = _encode(text, wrote)
        if raw is None:
            return None
        text = _decode(raw, read)
    return text


def invert(text: str, chain, errors: str = "strict") -> str | None:
    """What was written, None where the chain can't have made the text."""
    for wrote, read in reversed(chain):
        raw = _encode(text, read)
        if raw is None:
            return None
        text = _decode(raw, wrote, errors)
        if text is None:
            return None
    return text


#: Scripts that are written without spaces, and that no chain here makes, part units like white space.
_UNIT = re.compile(r"[^ \t\r\n\f\v⺀-퟿豈-﫿︰-﹏＀-￯]*[^\x00-\x7f⺀-퟿豈-﫿︰-﹏＀-￯][^ \t\r\n\f\v⺀-퟿豈-﫿︰-﹏＀-￯]*")
#: Runs from a character of such a script on, as far as white space: chains make units of them.
_RUN = re.compile(r"[⺀-퟿＀-￯][^ \t\r\n\f\v]*")
_WHITE = re.compile(r"[ \t\r\n\f\v]+")
_DIGIT = str.maketrans("123456789", "000000000")
_SPACE = str.maketrans("\t\r\n\f\v", "     ")


def units(text: str) -> list[str]:
    return _UNIT.findall(text)


def _features(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features in a row, start of each unit)."""
    raw = [(" " + p + " ").encode("utf-8", "replace") for p in parts]
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    size = np.array([len(r) for r in raw])
    end = np.cumsum(size)
    last = np.zeros(len(flat), bool)
    last[end - 1] = True
    pair = np.flatnonzero(~last)
    bigram = flat[pair] << np.uint64(8) | flat[pair + 1]
    # neighbouring characters: all bytes of both
    lead = np.flatnonzero((flat & np.uint64(0xC0)) != np.uint64(0x80))
    code = np.add.reduceat(flat * (np.uint64(257) ** (np.arange(len(flat)).astype(np.uint64) - np.repeat(lead, np.diff(np.append(lead, len(flat)))).astype(np.uint64))), lead)
    ends_here = np.isin(lead, end - 1)
    at = np.flatnonzero(~ends_here[: len(lead)])
    at = at[at + 1 < len(lead)]
    chars = code[at] * np.uint64(0x9E3779B97F4A7C15) + code[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)
    mix = lambda h: ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)
    with np.errstate(over="ignore"):
        f = np.concatenate([mix(bigram + np.uint64(77)), mix(chars)])
    owner = np.concatenate([np.searchsorted(end, pair, side="right"), np.searchsorted(end, lead[at], side="right")])
    o = np.argsort(owner, kind="stable")
    f, owner = f[o], owner[o]
    return f, np.searchsorted(owner, np.arange(len(parts)))


_MIX = np.uint64(0x9E3779B97F4A7C15)
_FIRST = np.concatenate([[0], np.cumsum([1 << b for b in SLOTS])])  # of each table, where all stand in one


def _codes(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of the texts between spaces, two before and one behind, and the length of each."""
    code = np.frombuffer("".join("  " + p + " " for p in parts).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    return code, np.array([len(p) + 3 for p in parts])


def _slots(code: np.ndarray, n: int) -> np.ndarray:
    """Of each run of n characters its place in the table of such runs."""
    key = code[: len(code) - n + 1].copy()
    for i in range(1, n):
        key = key << np.uint64(21) | code[i : len(code) - n + 1 + i]
    with np.errstate(over="ignore"):
        return ((key + np.uint64(n)) * _MIX >> np.uint64(64 - SLOTS[n - 1])).astype(np.int64)


def _count_runs(words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, weight) of the characters, pairs and triples of the words, in one numbering."""
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    code, size = _codes(words)
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    at, weight = [], []
    for n in (1, 2, 3):
        inside = place[: len(code) - n + 1] <= (size[owner] - n)[: len(code) - n + 1]
        if n == 1:
            inside &= place > 0
        at.append(_slots(code, n)[inside] + _FIRST[n - 1])
        weight.append(counts[owner[: len(code) - n + 1][inside]])
    slot, back = np.unique(np.concatenate(at), return_inverse=True)
    return slot, np.bincount(back, weights=np.concatenate(weight))


def _class_counts(chain, sample: list[tuple[str, int]]) -> np.ndarray:
    """Feature counts of the sample's units garbled by a chain, or of the units as they are where it is None."""
    row = np.zeros(1 << BITS, np.float32)
    made = sample if chain is None else [(g, n) for u, n in sample if (g := garble(u, chain)) is not None and g != u]
    # garbled forms part at white space too
    made = [(p, n) for g, n in made for p in ([g] if not _WHITE.search(g) and _UNIT.fullmatch(g) else units(g))]
    if made:
        f, start = _features([u for u, _ in made])
        np.add.at(row, f, np.repeat(np.sqrt([n for _, n in made]), np.diff(np.append(start, len(f)))).astype(np.float32))
    return row


class Model:
    """The classifier's weights and the character model."""

    def __init__(self, table: np.ndarray, classes: np.ndarray | None):
        self.uni, self.bi, self.tri = (table[a:b].astype(np.float32) for a, b in zip(_FIRST, _FIRST[1:]))
        self.total, self.base = float(self.uni.sum()), int((self.uni > 0).sum()) + 1
        if classes is not None:
            rows = classes + 0.05
            self.weight = np.log(rows / rows.sum(1, keepdims=True)).T.astype(np.float32).copy()
        self.cache: dict[str, list] = {}

    def plausible(self, parts: list[str]) -> np.ndarray:
        """Log probability of each text between spaces."""
        code, size = _codes(parts)
        start = np.cumsum(size) - size
        one, two, three = (_slots(code, n) for n in (1, 2, 3))
        x = self.uni[one[2:]].astype(np.float64)
        p1 = (x + 0.01) / (self.total + 0.01 * self.base)
        nb, ab = self.uni[one[1:-1]].astype(np.float64), self.bi[two[:-1]].astype(np.float64)
        p2, p3 = self.bi[two[1:]] / np.maximum(nb, 1), self.tri[three] / np.maximum(ab, 1)
        # a context seen often is trusted more
        w3, w2 = ab / (ab + 5.0), nb / (nb + 5.0)
        p = np.log(w3 * p3 + (1 - w3) * (w2 * p2 + (1 - w2) * p1) * 0.999 + 0.001 * p1)
        p = np.append(p, [0.0, 0.0])
        inside = np.concatenate([np.arange(s, s + n - 2) for s, n in zip(start, size)])
        return np.bincount(np.repeat(np.arange(len(parts)), size - 2), weights=p[inside], minlength=len(parts))

    def chains(self, parts: list[str]) -> list[np.ndarray]:
        """Of each unit the TRIED likeliest chains, of those likelier than that it is clean."""
        out = []
        for lo in range(0, len(parts), 2000):
            f, start = _features(parts[lo : lo + 2000])
            score = np.add.reduceat(self.weight[f], start, axis=0)
            lead = score[:, 1:] - score[:, :1]
            top = np.argpartition(-lead, TRIED - 1, axis=1)[:, :TRIED]
            by = np.take_along_axis(lead, top, 1)
            order = np.argsort(-by, axis=1, kind="stable")
            out += [t[o][b[o] > 0] for t, o, b in zip(top, order, by)]
        return out

    def judge(self, parts: list[str]) -> dict[str, list[tuple[float, int, bool]]]:
        """Of each unit (with 0 for every digit) what speaks for which chain, and whether it decodes strictly."""
        todo = list(dict.fromkeys(u for u in parts if u not in self.cache))
        if len(self.cache) > 400_000:
            self.cache = {}
            todo = list(dict.fromkeys(parts))
        for lo in range(0, len(todo), 5000):
            self._judge(todo[lo : lo + 5000])
        return self.cache

    def _judge(self, todo: list[str]) -> None:
        who, made, how, strict, extra = [], [], [], [], []
        for i, (u, tried) in enumerate(zip(todo, self.chains(todo))):
            self.cache[u] = []
            for k in tried:
                wide = CHAINS[k][0][0] in WIDE
                t = invert(u, CHAINS[k])
                whole = t is not None
                if t is None and wide:
                    t = invert(u, CHAINS[k], "replace")
                if t is not None and t != u:
                    who.append(i)
                    made.append(t.translate(_SPACE).translate(_DIGIT))
                    how.append(int(k))
                    strict.append(whole)
                    extra.append(_wide(k, t) if wide and whole else -LONE_ODDS * (len(u) == 1 and not wide))
        if not made:
            return
        before = self.plausible([u.translate(_SPACE) for u in todo])
        for i, k, s, x, p in zip(who, how, strict, extra, self.plausible(made)):
            odds = float(p - before[i]) + x
            if odds > COUNTED:
                self.cache[todo[i]].append((odds, k, s))

    def word_odds(self, words: list[str]) -> np.ndarray:
        """The largest odds of any unit of each word."""
        parts = [units(w) for w in words]
        known = self.judge([u for p in parts for u in p])
        return np.array([99.0 if LOST in w else max((x[0] for u in p for x in known[u]), default=-99.0) for w, p in zip(words, parts)])

    def evidence(self, text: str) -> tuple[dict[int, float], list[tuple[int, int, list]]]:
        """What the distinct units of a text come to for each chain; and (start, end, judgement) of the units."""
        found = list(_UNIT.finditer(text))
        known = self.judge([m.group().translate(_DIGIT) for m in found]) if found else {}
        at, by, seen = [], {}, set()
        for m in found:
            u = m.group().translate(_DIGIT)
            said = known[u]
            if said and len(u) == 1:
                beside = _beside(text, m.start(), m.end())
                said = [x for x in said if CHAINS[x[1]][0][0] in WIDE or all(c.isascii() or ord(c) in _BACK[CHAINS[x[1]][-1][1]] for c in beside)]
            at.append((m.start(), m.end(), said))
            if said and u not in seen:
                seen.add(u)
                for odds, k, _ in said:
                    by[k] = by.get(k, 0.0) + odds
        return by, at

    def odds(self, text: str) -> float:
        """What speaks for the likeliest chain."""
        if LOST in text:
            return 99.0
        return max(self.evidence(text)[0].values(), default=-99.0)

    def garbled(self, text: str) -> bool:
        return self.odds(text) >= ODDS

    def restore(self, text: str) -> tuple[str, bool]:
        """The text with every garbled unit restored where its chain decodes strictly; whether all were.

        In a text that chains are found in, a unit needs less: it is restored by the chain that most of the text speaks for, among those
        that are nearly the likeliest for it."""
        by, at = self.evidence(text)
        chains = sorted((k for k, v in by.items() if v >= ODDS), key=lambda k: (-by[k], k))[:TRIED]
        whole, out, last = LOST not in text, [], 0
        for a, b, said in at:
            mine = [x for x in said if by.get(x[1], 0.0) >= ODDS] or self._in_chains(text[a:b].translate(_DIGIT), chains)
            if not mine:
                continue
            most = max(x[0] for x in mine)
            _, k, strict = max((x for x in mine if x[0] > most - NEAR), key=lambda x: (by[x[1]], x[0], -x[1]))
            t = invert(text[a:b], CHAINS[k]) if strict else None
            whole = whole and t is not None
            if t is not None:
                out += [text[last:a], t]
                last = b
        return "".join([*out, text[last:]]), whole

    def _in_chains(self, unit: str, chains: list[int]) -> list[tuple[float, int, bool]]:
        """What speaks for each of some chains that the text is known to have gone through."""
        made = [(k, t) for k in chains if (t := invert(unit, CHAINS[k])) is not None and t != unit]
        if not made:
            return []
        p = self.plausible([unit.translate(_SPACE), *[t.translate(_SPACE).translate(_DIGIT) for _, t in made]])
        odds = [(float(q - p[0]) + (_wide(k, t) if CHAINS[k][0][0] in WIDE else 0.0), k, True) for (k, t), q in zip(made, p[1:])]
        return [x for x in odds if x[0] > FOLLOWS or CHAINS[x[1]][0][0] in WIDE]


def _wide(k: int, t: str) -> float:
    """The log odds of the sequences of several bytes that decoded to a text."""
    return WIDE_ODDS * min(WIDE_MOST, sum(not c.isascii() for c in t))


def _beside(text: str, start: int, end: int) -> str:
    """The words before and behind a place, as far as they stand in its line."""
    before, after = text[:start].rsplit("\n", 1)[-1].split(" "), text[end:].split("\n", 1)[0].split(" ")
    return "".join([*[w for w in before if w][-1:], *[w for w in after if w][:1]])


def _sample(counts: list[tuple[str, int]], most: int) -> list[tuple[str, int]]:
    """The most frequent of counted texts, within the bounds of the sample."""
    top = sorted(counts, key=lambda x: (-x[1], x[0]))[:most]
    kept = np.cumsum([len(u) for u, _ in top]) <= TRAIN_CHARS
    return [x for x, k in zip(top, kept) if k]


def _parts(words: list[str], counts: list[int]) -> tuple[dict[str, int], dict[str, int]]:
    """Counts of the units of the words, and of their runs of scripts without spaces."""
    u, r = {}, {}
    for w, n in zip(words, counts):
        for p in units(w):
            u[p] = u.get(p, 0) + n
        for p in _RUN.findall(w):
            r[p] = r.get(p, 0) + n
    return u, r


def train(texts: list[str]) -> Model:
    """The model of texts at hand."""
    count: dict[str, int] = {}
    for t in set(texts):
        for w in _WHITE.split(t.translate(_DIGIT)):
            if w:
                count[w] = count.get(w, 0) + 1
    model = None
    for _ in range(2):
        words, n = list(count), np.array(list(count.values()), np.float64)
        table = np.zeros(_FIRST[-1])
        slot, weight = _count_runs(words, n)
        table[slot] = weight
        u, r = _parts(words, list(count.values()))
        sample = [*_sample(list(u.items()), TRAIN_UNITS), *_sample(list(r.items()), TRAIN_RUNS)]
        clean = sample[: len(sample) - min(len(r), TRAIN_RUNS)]
        model = Model(table, np.stack([_class_counts(None, clean), *[_class_counts(c, sample) for c in CHAINS]]))
        odds = dict(zip(words, model.word_odds(words))) if words else {}
        count = {w: k for w, k in count.items() if odds[w] < LEFT_OUT}
    return model


def _fit(words: DataFrame) -> Model:
    """The model of counted ``words`` (w, n)."""
    spark = words.sparkSession

    def runs(batches):
        for b in batches:
            if b.num_rows:
                slot, weight = _count_runs(b.column("w").to_pylist(), b.column("n").to_numpy().astype(np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(weight)], names=["slot", "n"])

    table = np.zeros(_FIRST[-1])
    got = words.mapInArrow(runs, "slot int, n double").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table[got.column("slot").to_numpy()] = got.column("n").to_numpy()

    def parts(batches):
        for b in batches:
            for kind, c in enumerate(_parts(b.column("w").to_pylist(), b.column("n").to_pylist())):
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(c), pa.int32()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["kind", "u", "n"])

    counted = cut(words.where(F.col("w").rlike(r"[^\x00-\x7f]")).mapInArrow(parts, "kind int, u string, n bigint").groupBy("kind", "u").agg(F.sum("n").alias("n")))
    samples = []
    for kind, most in enumerate((TRAIN_UNITS, TRAIN_RUNS)):
        top = counted.where(F.col("kind") == kind).where(F.length("u") <= TRAIN_CHARS).orderBy(F.desc("n"), "u").limit(most).toArrow()
        samples.append(_sample(list(zip(top.column("u").to_pylist(), top.column("n").to_pylist())), most))
    sent = spark.sparkContext.broadcast(samples)

    def classes(batches):
        clean, runs_ = sent.value
        for b in batches:
            for k in b.column("id").to_pylist():
                row = _class_counts(None, clean) if k == 0 else _class_counts(CHAINS[k - 1], [*clean, *runs_])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([row.tobytes()], pa.binary())], names=["id", "row"])

    n = 1 + len(CHAINS)
    got = spark.range(0, n, 1, min(n, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(classes, "id bigint, row binary").toArrow()
    rows = np.zeros((n, 1 << BITS), np.float32)
    for k, raw in zip(got.column("id").to_pylist(), got.column("row").to_pylist()):
        rows[k] = np.frombuffer(raw, np.float32)
    return Model(table, rows)


def _judged(df: DataFrame, key: str, text: str):
    """(rows that may be garbled, the shared model)."""
    spark = df.sparkSession
    docs = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("t is not null")
    spaced = F.translate("t", "123456789\t\r\n\f\v", "000000000     ")
    words = docs.select("t").distinct().select(F.explode(F.split(spaced, " ")).alias("w")).where("w != ''").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    words = cut(words)
    first = spark.sparkContext.broadcast(_fit(words))

    def clean(batches):
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(first.value.word_odds(b.column("w").to_pylist()) < LEFT_OUT))

    outside = F.col("w").rlike(r"[^\x00-\x7f]")
    kept = words.where(~outside).union(words.where(outside).mapInArrow(clean, "w string, n bigint"))
    shared = spark.sparkContext.broadcast(_fit(cut(kept)))
    # ASCII alone can't be garbled; the test spares most of the texts the way to Python
    return docs.where("k is not null").where(F.col("t").rlike(r"[^\x00-\x7f]")), shared


def garbled_documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key) of the documents that were, wholly or in part, read in a wrong encoding."""
    rows, shared = _judged(df, key, text)

    def judge(batches):
        for b in batches:
            yield b.select(["k"]).filter(pa.array([shared.value.garbled(t) for t in b.column("t").to_pylist()], pa.bool_()))

    return rows.mapInArrow(judge, f"k {dict(rows.dtypes)['k']}").distinct().select(F.col("k").alias(key))


def restored_documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, restored, complete) of the garbled documents: the text with every garbled part restored that can be."""
    rows, shared = _judged(df, key, text)

    def judge(batches):
        m = shared.value
        for b in batches:
            texts = b.column("t").to_pylist()
            at = [i for i, t in enumerate(texts) if m.garbled(t)]
            made = [m.restore(texts[i]) for i in at]
            yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(at, pa.int64())), pa.array([r for r, _ in made], pa.string()), pa.array([w for _, w in made], pa.bool_())], names=["k", "restored", "complete"])

    out = rows.mapInArrow(judge, f"k {dict(rows.dtypes)['k']}, restored string, complete boolean")
    return out.groupBy(F.col("k").alias(key)).agg(F.min("restored").alias("restored"), F.min("complete").alias("complete"))
