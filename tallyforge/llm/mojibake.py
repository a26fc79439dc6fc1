"""Garbled text from wrong character encoding: find the chain of encodings, undo it.

A multinomial classifier over hashed byte bigrams tells how a word came about:
as it should, or through one of 210 chains (written as UTF-8 and read in a
single-byte encoding, once or twice; written in one single-byte encoding and
read in another). It is trained on words of the corpus garbled through every
chain. The chain predicted for a word is inverted, which must decode strictly
and give a word that the model of sound words finds much likelier. Words lost in
part (a byte dropped or replaced on the way) cannot be inverted; they count when
the classifier is sure.

Garbled characters that were then written as HTML references (``&Atilde;&copy;``)
are read as characters first; references of sound characters are no case.

Words are found as runs of characters beyond ASCII with the letters around
them, so documents garbled in one place are found too. ASCII is the same in all
these encodings, which makes the inversion of a run independent of its
surroundings.

Training sample: words of the ``SAMPLE`` different texts whose key has the least
hash, the ``WORDS`` commonest of them. A text counts once however often it is
copied, since a garbled text copied often would else be learnt as sound. Everything else covers all rows and whole texts.
The model (a fixed size, some 12 MB) is the only thing broadcast.

Defined cases: null, empty and plain ASCII texts are sound. A single replacement
mark at the end of a text is a cut, not a wrong encoding; any other replacement
mark is a case that cannot be restored. Repeated rows are judged alike. Without a
text to train on nothing is found. Extra columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, WORDS = 4_000, 4_000
FEATURES = 1 << 14
#: A word without any letter in more than this share of the sample is a sound
#: mark (tree lines, comparison signs); words with letters have no such pardon.
COMMON = 0.01
#: Log-odds from which on a word counts: where UTF-8 comes out of the inversion
#: (hardly any sound word is valid UTF-8 by chance), where it does not, and where
#: it should but bytes are lost, with the rest of a UTF-8 sequence left or without.
SURE_UTF8, SURE_INVERTED, SURE_BROKEN, SURE_LOST = 0.0, 12.0, 5.0, 15.0
#: Where the inversion gives a word that looks no better than the garbled one.
SURE_ALIKE = 24.0
#: How much likelier, in logs, the restored word must be as a sound word.
GAIN = 4.0
#: Likeliest chains of a word that are inverted.
TRIED = 8
#: Rounds of training, each without the garbled words that the one before found.
ROUNDS = 4

WEST = ("cp1252", "latin_1", "cp437", "cp850", "mac_roman", "iso8859_15")
CENTRE = ("cp1250", "iso8859_2", "cp852")
CYRILLIC = ("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic")
#: Every chain is a list of (written, read) steps.
Chain = tuple[tuple[str, str], ...]


def chains() -> list[Chain]:
    """The sound chain (no step) first."""
    single = [*WEST, *CENTRE, *CYRILLIC]
    out: list[Chain] = [()]
    out += [(("utf_8", e),) for e in single]
    out += [(("utf_8", a), ("utf_8", b)) for a, b in [(e, e) for e in single] + [("cp1252", "latin_1"), ("latin_1", "cp1252"), ("cp1252", "cp1250"), ("cp1250", "cp1252")]]
    for family in (WEST, CENTRE, CYRILLIC):
        out += [((a, b),) for a in family for b in single if a != b and {a, b} not in ({"cp1252", "latin_1"}, {"latin_1", "iso8859_15"})]
    return out


def _tables(name: str) -> tuple[dict[int, str], dict[str, int]]:
    """How an encoding reads bytes and writes characters; bytes it has no character for stand for themselves."""
    read = {b: bytes([b]).decode(name, "replace") for b in range(256)}
    read = {b: (c if c != "�" else chr(b)) for b, c in read.items()}
    return read, {c: b for b, c in reversed(read.items())}


class Codec:
    """Applies and inverts chains."""

    def __init__(self) -> None:
        names = {n for c in chains() for step in c for n in step} - {"utf_8"}
        self.tables = {n: _tables(n) for n in names}
        self.reading = {n: {b: ord(c) for b, c in t[0].items()} for n, t in self.tables.items()}

    def write(self, text: str, name: str) -> bytes | None:
        if name == "utf_8":
            try:
                return text.encode()
            except UnicodeEncodeError:
                return None
        table = self.tables[name][1]
        try:
            return bytes([table[c] for c in text])
        except KeyError:
            return None

    def read(self, data: bytes, name: str) -> str | None:
        if name == "utf_8":
            try:
                return data.decode()
            except UnicodeDecodeError:
                return None
        return data.decode("latin_1").translate(self.reading[name])

    def garble(self, text: str, chain: Chain) -> str | None:
        for written, read in chain:
            data = self.write(text, written)
            text = None if data is None else self.read(data, read)
            if text is None:
                return None
        return text

    def restore(self, text: str, chain: Chain) -> str | None:
        """The text before the chain; ``None`` where a step does not decode strictly."""
        for written, read in reversed(chain):
            data = self.write(text, read)
            text = None if data is None else self.read(data, written)
            if text is None:
                return None
        return text


_RUN = re.compile(r"[^\x00-\x7f]+(?:[A-Za-z]{1,6}[^\x00-\x7f]+)*")
_CONTROLS = re.compile(r"[\x80-\x9f]")
_BROKEN = re.compile(rb"[\xc2-\xf4][\x80-\xbf]")
_HEAD, _TAIL = re.compile(r"[A-Za-z]{0,4}\Z"), re.compile(r"[A-Za-z]{0,4}")
#: Marks that sound text puts beside names and code; a run of only these needs no context.
_MARKS = re.compile(r"[‐-‧′-›─-╿☐-⛿✀-➿«»→…]+\Z")


def words(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, word): runs beyond ASCII, and the word with up to four letters on either side."""
    for m in _RUN.finditer(text):
        a, b = m.span()
        if _MARKS.match(m.group()):
            yield a, b, m.group()
        else:
            yield a, b, _HEAD.search(text, max(0, a - 4), a).group() + m.group() + _TAIL.match(text, b, b + 4).group()


def bigrams(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed byte bigrams, start of each key's); keys lie between line ends, which mark where they begin and end."""
    data = [k.encode("utf_8", "surrogatepass") for k in keys]
    flat = np.frombuffer(b"\n" + b"\n".join(data) + b"\n", np.uint8).astype(np.uint32)
    pair = flat[:-1] * np.uint32(256) + flat[1:]
    feature = (pair * np.uint32(2654435761)) >> np.uint32(32 - 14)
    sizes = np.array([len(d) + 1 for d in data])
    return feature.astype(np.int64), np.cumsum(sizes) - sizes


@dataclass
class Model:
    chains: list[Chain]
    weight: np.ndarray  # features x chains, log-probabilities

    def scores(self, keys: list[str]) -> np.ndarray:
        """Log-likelihood of each key under each chain."""
        out = np.empty((len(keys), len(self.chains)), np.float32)
        for at in range(0, len(keys), 1000):
            feature, start = bigrams(keys[at : at + 1000])
            out[at : at + 1000] = np.add.reduceat(self.weight[feature], start, axis=0)
        return out


def _fit(groups: list[tuple[list[str], np.ndarray]]) -> np.ndarray:
    weight = np.empty((FEATURES, len(groups)), np.float32)
    for i, (keys, count) in enumerate(groups):
        total = np.full(FEATURES, 0.02 if i else 0.01)
        if keys:
            feature, start = bigrams(keys)
            sizes = np.diff(np.append(start, len(feature)))
            total += np.bincount(feature, np.repeat(count, sizes), FEATURES)
        weight[:, i] = np.log(total / total.sum())
    return weight


def train(counts: dict[str, int], documents: int) -> Model:
    """A model from words and the number of documents that hold each, some of them garbled.

    The garbled words among them are found by a first model and left out of the
    second, however common they are; only common marks stay.
    """
    codec, ways = Codec(), chains()
    known = sorted(counts, key=lambda k: (-counts[k], k))[:WORDS]
    known = [k for k in known if "�" not in k]
    for _ in range(ROUNDS):
        groups = []
        for c in ways:
            made: dict[str, float] = {}
            for k in known:
                g = codec.garble(k, c)
                if g is not None and (not c or g != k):
                    made[g] = made.get(g, 0.0) + min(counts[k], 50)
                    bare = _CONTROLS.sub("", g) if c else g  # some readers drop control characters
                    if bare != g:
                        made[bare] = made.get(bare, 0.0) + min(counts[k], 50) / 2
            groups.append((list(made), np.array(list(made.values()))))
        model = Model(ways, _fit(groups))
        judged = judge(model, codec, known)
        known = [k for k, j in zip(known, judged, strict=True) if j is None or j[3] or (counts[k] > COMMON * documents and not any(map(str.isalpha, k)))]
    return model


def oddness(word: str) -> int:
    """How unlike a word of any language a run of characters is: marks between letters, capitals after small letters,
    letters of two scripts side by side. Nothing here is learnt."""
    n = 0
    for a, b in zip(word, word[1:], strict=False):
        if a.isalpha() != b.isalpha():
            n += not (a.isascii() and not a.isalpha()) and not (b.isascii() and not b.isalpha())
        elif a.isalpha():
            n += (a.islower() and b.isupper()) + ((ord(a) >= 0x370) != (ord(b) >= 0x370))
    inner = word.strip("“”„«»‘’…–—\"'")
    return n if inner == word else min(n, oddness(inner))


Judged = tuple[int, float, "str | None", bool]


def judge(model: Model, codec: Codec, keys: list[str]) -> list[Judged | None]:
    """(chain, log-odds against a sound word, restored word, alike) of each key that is garbled, else ``None``.

    ``alike``: the restored word looks no more like one than the key does, so it
    counts only beside others of the same chain.
    """
    out: list[Judged | None] = []
    if not keys:
        return out
    scores = model.scores(keys)
    odds = scores - scores[:, :1]
    best = np.argsort(-odds, axis=1)[:, :TRIED]
    tried: list[tuple[int, int, float, str]] = []
    for i, k in enumerate(keys):
        for c in best[i].tolist():
            if c and odds[i, c] >= (SURE_UTF8 if model.chains[c][0][0] == "utf_8" else SURE_INVERTED):
                back = codec.restore(k, model.chains[c])
                if back is not None and back != k:
                    tried.append((i, c, float(odds[i, c]), back))
    sound = model.scores([t[3] for t in tried])[:, 0] if tried else np.empty(0)
    good: dict[int, tuple[tuple[bool, float], int, float, str]] = {}
    for (i, c, o, back), s in zip(tried, sound.tolist(), strict=True):
        if model.chains[c][0][0] != "utf_8":
            # letters read as other letters: the word put right must look more like one, or the odds leave no doubt
            better = oddness(keys[i]) - oddness(back)
            alike = better < 0 or (better == 0 and o < SURE_ALIKE)
        else:
            alike = False
        if s - float(scores[i, 0]) >= GAIN and (i not in good or (not alike, o + s) > good[i][0]):
            good[i] = ((not alike, o + s), c, o, back)
    for i in range(len(keys)):
        if i in good:
            out.append((*good[i][1:], not good[i][0][0]))
        else:
            c, o = int(best[i, 0]), float(odds[i, best[i, 0]])
            lost = c and model.chains[c][0][0] == "utf_8" and o >= (SURE_BROKEN if _BROKEN.search(codec.write(keys[i], model.chains[c][-1][1]) or b"") else SURE_LOST)
            out.append((c, o, None, False) if lost else None)
    return out


def is_weak(key: str, chain: Chain) -> bool:
    """One character on its own, read in another single-byte encoding: it could stand for anything."""
    return len(key) == 1 and chain[0][0] != "utf_8"


def is_lost(text: str) -> bool:
    """Whether a text holds replacement marks other than one at its end."""
    at = text.find("�")
    return at >= 0 and text[at + 1 :].strip() != ""


#: Words a task remembers the verdict of before it starts anew.
REMEMBERED = 300_000


class Reader:
    """Judges texts with a trained model and remembers the verdicts on words."""

    def __init__(self, model: Model) -> None:
        self.model, self.codec = model, Codec()
        self.seen: dict[str, Judged | None] = {}

    def learn(self, keys: Iterable[str]) -> None:
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        new = [k for k in dict.fromkeys(keys) if k not in self.seen]
        for at in range(0, len(new), 2000):
            self.seen.update(zip(new[at : at + 2000], judge(self.model, self.codec, new[at : at + 2000]), strict=True))

    def read(self, text: str, found: list[tuple[int, int, str]]) -> tuple[str, int, int, str] | None:
        """(chain, garbled words, those restored, restored text) of a garbled text, its words given; else ``None``."""
        hits = [(a, b, k, self.seen[k]) for a, b, k in found if "�" not in k and self.seen.get(k)]
        strong: dict[int, int] = {}
        for _, _, k, j in hits:
            if not is_weak(k, self.model.chains[j[0]]) and not j[3]:
                strong[j[0]] = strong.get(j[0], 0) + 1
        if not strong and not is_lost(text):
            return None
        main = min(strong, key=lambda c: (-strong[c], c)) if strong else None
        out, at, n, back = [], 0, 0, 0
        for a, b, k, j in hits:
            chain = self.model.chains[j[0]]
            if is_weak(k, chain) and j[0] not in strong or j[3] and strong.get(j[0], 0) < 2:
                continue
            n += 1
            # the chain of most of the text goes before that of a word, if it fits
            good = self.codec.restore(text[a:b], self.model.chains[main]) if main is not None and strong[main] > 2 and chain[0][0] == "utf_8" else None
            if good is None:
                good = self.codec.restore(text[a:b], chain) if j[2] is not None else None
            if good is not None:
                out += [text[at:a], good]
                at, back = b, back + 1
        n += text.count("�")
        name = "lost" if main is None else ">".join(x for step in self.model.chains[main] for x in step)
        return name, n, back, "".join(out) + text[at:]


#: A reference to a character, by name or number.
_REFERENCE = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});")


def dereferenced(text: str) -> str:
    """A text with its HTML references to characters beyond ASCII read; all others stay."""
    if "&" not in text:
        return text

    def character(m: re.Match) -> str:
        c = html.unescape(m[0])
        return c if c != m[0] and not c.isascii() else m[0]

    return _REFERENCE.sub(character, text)


def learnt(docs: DataFrame, key: str, text: str) -> Model:
    """A model trained on words of a bounded sample of the different texts."""
    first = docs.filter(F.col(text).isNotNull()).groupBy(F.unhex(F.md5(text)).alias("__h")).agg(F.min(F.struct(F.xxhash64(key).alias("x"), F.col(key).alias("id"))).alias("__f"))
    ids = first.select("__f.*").orderBy("x", "id").limit(SAMPLE).select(F.col("id").alias("__id"))
    sample = docs.join(F.broadcast(ids), docs[key] == ids["__id"], "left_semi").select(F.col(text).alias("t"), F.unhex(F.md5(text)).alias("h")).filter(F.col("t").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(k, h) for t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if not t.isascii() for k in {k for _, _, k in words(t)}]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([h for _, h in found], pa.binary())], names=["k", "h"])

    common = sample.mapInArrow(count, "k string, h binary").distinct().groupBy("k").count().orderBy(F.desc("count"), "k").limit(WORDS)
    return train({r["k"]: r["count"] for r in common.collect()}, SAMPLE)


def garbled(docs: DataFrame, key: str, text: str, corpus: DataFrame | None = None) -> DataFrame:
    """(key, chain, words, restored_words, restored): the garbled documents.

    The model is trained on a sample of ``corpus``, by default of the documents themselves.

    ``chain`` is the commonest in the text, ``lost`` where only replacement
    marks are left; ``restored`` is the text with every word put right that can
    be. The documents are read once, where they lie, after the model is there.
    """
    kind = docs.schema[key].dataType.simpleString()
    model = docs.sparkSession.sparkContext.broadcast((lambda m: (m.chains, m.weight))(learnt(docs if corpus is None else corpus, key, text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Model(*model.value))
        for b in batches:
            rows = []
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                todo = []
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    u = dereferenced(t) if t else t
                    if u and not u.isascii():
                        todo.append((i, t, u, list(words(u))))
                reader.learn(k for _, _, _, found in todo for _, _, k in found if "�" not in k)
                for i, t, u, found in todo:
                    if r := reader.read(u, found):
                        # without a garbled word the references stay as they are
                        rows.append((i, r[0] if t == u else f"{r[0]}>html", *r[1:]) if r[0] != "lost" or t == u else (i, *(reader.read(t, list(words(t))) or r)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [b.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "chain", "words", "restored_words", "restored"])

    found = docs.select(F.col(key), F.col(text)).mapInArrow(run, f"key {kind}, chain string, words bigint, restored_words bigint, restored string")
    return found.withColumnRenamed("key", key)
