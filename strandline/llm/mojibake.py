"""Text that was decoded with the wrong character encoding: find the records and restore what was not lost.

Every distinct non-ASCII word of the corpus is garbled along every chain of (true encoding, wrong decoder); the garbled
forms are hash-joined with the words that documents hold. A hit names the word it may come from. What a chain does to a
clean word of many texts and what stands in few texts is taken as garbled, and so is what several words of one text say
together; copies of a text count once. The substitution is verified by garbling the original again. The word table follows the vocabulary, which grows far slower than the corpus, and all
joins are shuffle joins on the word.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import stored

#: Wrong decoders of UTF-8 bytes, fixed values: names of codecs; "ansi" is Windows-1252 with the five unassigned bytes kept as control characters.
UTF8_READ_AS = (
    "ansi", "latin-1", "iso8859-15", "cp1250", "cp1251", "cp1253", "cp1254", "iso8859-2", "koi8-r", "mac_roman",
    "cp437", "cp850", "cp852", "cp866", "gb18030", "cp932", "big5", "euc_kr",
)
#: Legacy bytes and what they were read as.
LEGACY_READ_AS = {
    "cp1252": ("utf-8", "mac_roman", "cp1250", "cp1251", "cp437", "cp850", "iso8859-2"),
    "mac_roman": ("ansi", "latin-1"),
    "cp437": ("ansi", "latin-1"),
    "cp850": ("ansi", "latin-1"),
    "cp1250": ("ansi", "latin-1", "utf-8", "iso8859-2", "cp852", "cp1251"),
    "iso8859-2": ("ansi", "latin-1", "cp1250", "utf-8"),
    "cp852": ("ansi", "latin-1", "cp1250"),
    "cp1251": ("ansi", "latin-1", "cp866", "koi8-r", "mac_roman", "cp1250", "utf-8"),
    "koi8-r": ("cp1251", "ansi", "latin-1", "cp866", "utf-8"),
    "cp866": ("cp1251", "ansi", "latin-1", "koi8-r"),
    "iso8859-5": ("cp1251", "ansi", "latin-1"),
    "mac_cyrillic": ("cp1251", "ansi"),
    "gb18030": ("ansi", "latin-1", "big5", "cp932", "euc_kr", "utf-8"),
    "big5": ("ansi", "latin-1", "gb18030", "utf-8"),
    "cp932": ("ansi", "latin-1", "gb18030", "utf-8"),
    "euc_jp": ("ansi", "latin-1", "cp932", "gb18030", "utf-8"),
}
LOST = "�"
_RUN = re.compile(r"[^\x00-\x7f]+")
_GAPS = "\t\r\n\x0b\x0c\x1c\x1d\x1e\x1f"  # beside the blank; no-break spaces may be part of garbled characters
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_CONTROLS = re.compile("[\x80-\x9f]")
_DIGITS = re.compile(r"[0-9][0-9.,:]*")
_OUTER = re.compile(r"^\W+|\W+$")
#: Marks at which unspaced scripts are cut into clauses.
CLAUSE_MARKS = "。，、：；！？（）"


_ANSI = "".join(chr(ord(c) - 0xDC00) if "\udc80" <= c <= "\udcff" else c for c in bytes(range(256)).decode("cp1252", "surrogateescape"))


def _decode(data: bytes, codec: str, errors: str) -> str:
    if codec != "ansi":
        return data.decode(codec, errors)
    return codecs.charmap_decode(data, "strict", _ANSI)[0]


def _encode(text: str, codec: str) -> bytes:
    if codec != "ansi":
        return text.encode(codec)
    return b"".join(bytes([ord(c)]) if "\x80" <= c <= "\x9f" else c.encode("cp1252") for c in text)


def garbled_forms(word: str) -> dict[str, tuple[str, bool]]:
    """{garbled form: (chain, lossless)} of a word along every chain; the first chain that gives a form names it.

    Chains of UTF-8 are also taken twice for the Western decoders, and once with the control characters, or what the
    decoder has no character for, dropped.
    """
    out: dict[str, tuple[str, bool]] = {}

    def add(form: str, chain: str, data: bytes | None, codec: str) -> None:
        if form and form != word and form not in out and not form.isascii():
            try:
                lossless = data is not None and LOST not in form and _encode(form, codec) == data
            except UnicodeEncodeError:
                lossless = False
            out[form] = (chain, lossless)

    utf8 = word.encode("utf-8", "surrogatepass")
    for codec in UTF8_READ_AS:
        once = _decode(utf8, codec, "replace")
        add(once, f"utf-8>{codec}", utf8, codec)
        if codec in ("ansi", "latin-1", "mac_roman"):
            data = once.encode("utf-8")
            add(_decode(data, codec, "replace"), f"utf-8>{codec}>utf-8>{codec}", data, codec)
        if LOST in once:
            add(_decode(utf8, codec, "ignore"), f"utf-8>{codec} ignored", None, codec)
    add(_CONTROLS.sub("", utf8.decode("latin-1")), "utf-8>latin-1 without controls", None, "latin-1")
    for true, wrongs in LEGACY_READ_AS.items():
        try:
            data = word.encode(true)
        except UnicodeEncodeError:
            continue
        for codec in wrongs:
            add(_decode(data, codec, "replace"), f"{true}>{codec}", data, codec)
    return out


#: Decoders that lose other characters at the end of a text than before a line break, where a digit stands near the end.
_WIDE = ("gb18030",)
_ASCII_DIGITS = frozenset("0123456789")


_TESTED: dict[str, dict[str, bool]] = {}


def _encodable(codec: str, characters: set[str]) -> set[str]:
    """Those of the characters that an encoding has; each is tried once per worker."""
    tested = _TESTED.setdefault(codec, {})
    for c in characters - tested.keys():
        try:
            c.encode(codec)
            tested[c] = True
        except UnicodeEncodeError:
            tested[c] = False
    return {c for c in characters if tested[c]}


_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base modulo 2**64, and their inverses."""
    if len(_POWERS.get("up", ())) < n:
        n = max(1 << 18, 1 << n.bit_length())
        for name, x in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, x, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def hashes(lines: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(31-bit hash, start, end) of the pieces between line breaks: a polynomial over the bytes, all pieces by one running sum."""
    data = np.frombuffer(lines, dtype=np.uint8)
    up, down = _powers(len(data) + 1)
    upto = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(np.multiply(data, up[: len(data)], dtype=np.uint64), out=upto[1:])
    cuts = np.flatnonzero(data == 10)
    start, end = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(data)]])
    h = (upto[end] - upto[start]) * down[start]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(33)).astype(np.int64), start, end


def held_forms(words: list[str], held: Callable[[np.ndarray], np.ndarray]) -> tuple[list[tuple[int, str, str, bool]], int | None]:
    """([(index of the word, form, chain, lossless)], index of a word that some chain loses characters of): what
    :func:`garbled_forms` gives for each word, of the forms whose hash ``held`` lets pass. A chain is run over all words at
    once, and its forms are hashed at once; only those that pass become strings."""
    out: dict[tuple[int, str], tuple[str, bytes | None, str]] = {}
    if not words:
        return [], None
    lossy: list[int] = []
    every = np.arange(len(words))
    joined = "\n".join(words)
    utf8 = joined.encode("utf-8", "surrogatepass")
    plain = hashes(utf8)[0]

    def take(at: np.ndarray, lines: str, chain: str, data: Callable[[int], bytes | None], codec: str) -> None:
        if not lossy and LOST in lines:
            lossy.append(int(at[lines.count("\n", 0, lines.index(LOST))]))
        raw = lines.encode("utf-8", "surrogatepass")
        h, start, end = hashes(raw)
        for j in np.flatnonzero(held(h) & (h != plain[at]) & (end > start)).tolist():
            i, form = int(at[j]), raw[start[j] : end[j]].decode("utf-8", "surrogatepass")
            if not form.isascii() and (i, form) not in out:
                out[i, form] = (chain, data(i), codec)

    def decoded(data: bytes, each: Callable[[int], bytes], at: np.ndarray, codec: str) -> str:
        lines = _decode(data, codec, "replace")
        if codec not in _WIDE or LOST not in lines:
            return lines
        forms = lines.split("\n")
        if len(forms) != len(at):
            return "\n".join(_decode(each(i), codec, "replace") for i in at)
        return "\n".join(_decode(each(i), codec, "replace") if LOST in f and any(c in _ASCII_DIGITS for c in words[i][-2:]) else f for i, f in zip(at, forms))

    own = lambda i: words[i].encode("utf-8", "surrogatepass")
    nothing = lambda i: None
    for codec in UTF8_READ_AS:
        once = decoded(utf8, own, every, codec)
        take(every, once, f"utf-8>{codec}", own, codec)
        if codec in ("ansi", "latin-1", "mac_roman"):
            again = lambda i, codec=codec: _decode(own(i), codec, "replace").encode("utf-8")
            take(every, _decode(once.encode("utf-8"), codec, "replace"), f"utf-8>{codec}>utf-8>{codec}", again, codec)
        if LOST in once:
            lost = np.array([i for i, form in enumerate(once.split("\n")) if LOST in form])
            if codec in _WIDE and any(c in _ASCII_DIGITS for i in lost for c in words[i][-2:]):
                left = "\n".join(_decode(own(i), codec, "ignore") for i in lost)
            else:
                left = _decode("\n".join(words[i] for i in lost).encode("utf-8", "surrogatepass"), codec, "ignore")
            take(lost, left, f"utf-8>{codec} ignored", nothing, codec)
    take(every, _CONTROLS.sub("", utf8.decode("latin-1")), "utf-8>latin-1 without controls", nothing, "latin-1")
    letters = [set(w) for w in words]
    characters = set().union(*letters)
    for true, wrongs in LEGACY_READ_AS.items():
        known = _encodable(true, characters)
        at = every if len(known) == len(characters) else np.array([i for i, w in enumerate(letters) if w <= known], dtype=np.int64)
        if not len(at):
            continue
        mine = lambda i, true=true: words[i].encode(true)
        data = "\n".join(words[i] for i in at).encode(true)
        for codec in wrongs:
            take(at, decoded(data, mine, at, codec), f"{true}>{codec}", mine, codec)

    def lossless(form: str, data: bytes | None, codec: str) -> bool:
        try:
            return data is not None and LOST not in form and _encode(form, codec) == data
        except UnicodeEncodeError:
            return False

    return [(i, form, chain, lossless(form, data, codec)) for (i, form), (chain, data, codec) in out.items()], lossy[0] if lossy else None


@lru_cache(maxsize=1)
def _clause_split() -> tuple[re.Pattern, re.Pattern]:
    """The clause marks, clean and along every chain, and what they may begin with."""
    forms = set(CLAUSE_MARKS)
    for mark in CLAUSE_MARKS:
        forms.update(f for f in garbled_forms(mark) if len(f) > 1 and LOST not in f)
    first = "".join(sorted({f[0] for f in forms}))
    return re.compile("|".join(re.escape(f) for f in sorted(forms, key=lambda f: (-len(f), f)))), re.compile(f"[{re.escape(first)}]")


def _units(token: str) -> tuple[str, ...]:
    """The units of a white-space token that is not ASCII, the token without outer ASCII marks first."""
    split, begins = _clause_split()
    core = token.strip(_EDGE)
    out = [core, _OUTER.sub("", core)]
    cuts = begins.search(core) is not None
    if len(core) > 4:
        out.extend(p for p in _DIGITS.split(core) if len(p) > 2)
    if len(core) > 8 and cuts:
        out.extend(p.strip(_EDGE) for p in split.split(core))
    for m in _RUN.finditer(token):
        run, a, b = m.group(), m.start(), m.end()
        open_ = (a == 0 or not token[a - 1].isalpha()) and (b == len(token) or not token[b].isalpha())
        if len(run) >= 3 or open_:
            out.append(run)
        if len(run) > 4 and cuts:
            out.extend(p for p in split.split(run) if len(p) > 1)
    return (core, *{w for w in out if w and not w.isascii()})


def words(text: str, known: dict[str, tuple[str, ...]] | None = None) -> tuple[set[str], set[str]]:
    """(units, white-space words) of a text, none ASCII: white-space words without outer ASCII marks and without any outer marks, runs of
    non-ASCII characters that are long enough to mean something or stand between no letters, what stands between numbers, and the clauses of
    all. U+FFFD is a unit of its own. ``known`` keeps the units of short tokens, which come again and again."""
    out: set[str] = set()
    cores: set[str] = set()
    known = {} if known is None else known
    parted = text
    for c in _GAPS:
        if c in parted:
            parted = parted.replace(c, " ")
    for token in set(parted.split(" ")):
        if token.isascii():
            continue
        units = known.get(token)
        if units is None:
            units = _units(token)
            if len(token) <= 40:
                if len(known) >= 200_000:
                    known.clear()
                known[token] = units
        cores.add(units[0])
        out.update(units[1:])
    if LOST in text:
        out.add(LOST)
    return out, cores


def document_words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(*key, word, source, whole) distinct within a row; null texts have none. ``source`` is equal for equal texts;
    ``whole`` marks the white-space words, of which no two overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        for batch in (b.slice(low, 500) for b in batches for low in range(0, b.num_rows, 500)):
            rows, found, whole = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t and not t.isascii():
                    mine, cores = words(t, known)
                    rows.extend([i] * len(mine))
                    found.extend(mine)
                    whole.extend([w in cores for w in mine])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(found, pa.string()), batch.column(2).take(at), pa.array(whole, pa.bool_())], names=["key", "word", "source", "whole"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("source")).mapInArrow(run, f"key {kind}, word string, source bigint, whole boolean")


#: Typographic characters that count as known words whether or not the corpus holds them clean; fixed values.
TYPOGRAPHIC = "‘’“”„–—…•·€™©®°«»"
#: Chains in which one character of the original becomes a fixed string, so that a run can be cut into characters. The
#: value is the least number of characters, three of them different where it is above one, that must come out of a run that is no known word.
BY_CHARACTER = {f"utf-8>{c}": 1 for c in UTF8_READ_AS} | {
    "utf-8>latin-1>utf-8>latin-1": 1, "utf-8>ansi>utf-8>ansi": 1, "utf-8>mac_roman>utf-8>mac_roman": 1, "utf-8>latin-1 without controls": 4,
    "gb18030>ansi": 4, "gb18030>latin-1": 4, "big5>ansi": 4, "big5>latin-1": 4, "euc_jp>ansi": 4, "euc_jp>latin-1": 4,
}
#: A legacy form counts as garbled where its original stands in so many times as many texts.
RATIO = 3
#: The same for forms of two characters. Of one character alone no ratio tells a form from a clean letter or sign.
SHORT_RATIO = 100
#: A symbol within a form of two characters, or a capital after a small letter: no clean word.
SYMBOL = r"[^\p{L}\p{M}\p{N}\x00-\x7f]|\p{Ll}\p{Lu}"
#: So many whole words of one text, of so many characters each, that are forms of known words along one chain are evidence.
EVIDENCE, EVIDENCE_LENGTH = 2, 3
#: What clean words do not look like: a symbol between letters, a capital after a small letter, two scripts, four accented Latin letters in a row.
ODD = r"\p{L}[^\p{L}\p{M}\p{N}\x00-\x7f’‘ʼ·‐‑–—…]\p{L}|\p{Ll}\p{Lu}|\p{IsLatin}[\p{IsCyrillic}\p{IsGreek}]|[\p{IsCyrillic}\p{IsGreek}]\p{IsLatin}|[\x{c0}-\x{24f}]{4}"
#: Bits of the set over the vocabulary for each word, and at most (2**31: 256 MB). Beyond, more forms pass that no document holds; the join drops them.
BITS_PER_WORD, MOST_BITS = 64, 31
WITHOUT = "utf-8>latin-1 without controls"


def _plain(word: str) -> bool:
    """False for words that cannot be clean: they hold lost or control characters or those of private use."""
    return not any(c == LOST or "\x80" <= c <= "\x9f" or "\ue000" <= c <= "\uf8ff" for c in word)


def word_bits(vocabulary: DataFrame) -> tuple[int, np.ndarray]:
    """(log2 of the number of bits, the set): one bit per hash of a word. A clear bit says that no document holds a word.

    Sized by the vocabulary up to ``MOST_BITS``. Words are or-ed together on the executors, first to 64 bits, then to blocks of 64 KB;
    only the finished blocks are collected.
    """
    n = vocabulary.count()
    size = min(max(n * BITS_PER_WORD, 1 << 16).bit_length(), MOST_BITS)
    mask = (1 << size) - 1

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(hashes("\n".join(batch.column(0).to_pylist()).encode())[0] & mask, pa.int64())], names=["at"])

    longs = vocabulary.select("word").mapInArrow(hashed, "at bigint").groupBy(F.shiftright("at", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("b"))
    blocks = longs.groupBy(F.shiftright("i", 13).alias("block")).agg(F.collect_list(F.struct("i", "b")).alias("l"))  # at most 8,192 each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for items in batch.column(1):
                block = np.zeros(1 << 13, dtype=np.int64)
                values = items.values
                block[values.field(0).to_numpy(zero_copy_only=False) & 8191] = values.field(1).to_numpy(zero_copy_only=False)
                out.append(block.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["block", "bits"])

    bits = np.zeros(1 << (size - 3), dtype=np.uint8)
    for row in blocks.mapInArrow(run, "block bigint, bits binary").toLocalIterator():
        part = np.frombuffer(row.bits, dtype=np.uint8)
        low = row.block << 16
        bits[low : low + len(part)] |= part[: len(bits) - low]
    return size, bits


def garbled_table(vocabulary: DataFrame) -> DataFrame:
    """(garbled, original, chain, lossless, n_original) of every clean word along every chain, without forms that no
    document holds for sure. U+FFFD stands for the characters that any of them loses."""
    size, made = word_bits(vocabulary)
    shared = vocabulary.sparkSession.sparkContext.broadcast(made)
    mask = (1 << size) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value

        def held(h: np.ndarray) -> np.ndarray:
            at = h & mask
            return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

        kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64()]
        for whole in batches:
            for low in range(0, whole.num_rows, 2000):
                batch = whole.slice(low, 2000)
                pairs = [(w, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if _plain(w)]
                found, lossy = held_forms([w for w, _ in pairs], held)
                out = [(form, pairs[i][0], chain, lossless, pairs[i][1]) for i, form, chain, lossless in found]
                if lossy is not None:
                    out.append((LOST, pairs[lossy][0], "lost", False, pairs[lossy][1]))
                cols = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["garbled", "original", "chain", "lossless", "n_original"])

    return vocabulary.mapInArrow(run, "garbled string, original string, chain string, lossless boolean, n_original bigint")


def _foreign(c: Column | str) -> Column:
    return F.length(F.regexp_replace(c, r"[\x00-\x7f]", ""))


def character_forms(characters: set[str]) -> dict[str, dict[str, str]]:
    """{chain: {garbled form: character}}: at most as many entries as Unicode has characters, per chain."""
    out: dict[str, dict[str, str]] = {c: {} for c in BY_CHARACTER}
    for c in sorted(characters):
        for form, (chain, _) in garbled_forms(c).items():
            if chain in out and (len(form) > 1 or chain == WITHOUT):
                out[chain].setdefault(form, c)
    # forms that an earlier chain named belong to every chain that makes them
    for codec in UTF8_READ_AS:
        for c in sorted(characters):
            form = _decode(c.encode("utf-8"), codec, "replace")
            if len(form) > 1:
                out[f"utf-8>{codec}"].setdefault(form, c)
    for c in sorted(characters):
        form = _CONTROLS.sub("", c.encode("utf-8").decode("latin-1"))
        if form:
            out[WITHOUT].setdefault(form, c)
    return out


def cut_run(run: str, forms: dict[str, dict[str, str]], longest: dict[str, int], begins: dict[str, set[str]]) -> tuple[str, str] | None:
    """(original, chain) of a run that falls into garbled characters of one chain without rest, longest form first."""
    for chain, known in forms.items():
        if run[:1] not in begins[chain]:
            continue
        at, out, top = 0, [], longest[chain]
        while at < len(run):
            for size in range(min(top, len(run) - at), 0, -1):
                c = known.get(run[at : at + size])
                if c is not None:
                    out.append(c)
                    at += size
                    break
            else:
                break
        least = BY_CHARACTER[chain]
        if at == len(run) and len(out) >= least and len(set(out)) >= min(least, 3):
            return "".join(out), chain
    return None


def garbles_to(original: str, chain: str, word: str) -> bool:
    """Whether the chain makes exactly ``word`` of ``original``, and the way back gives the original again."""
    steps = chain.split(">")
    text = original
    try:
        for true, wrong in zip(steps[::2], steps[1::2]):
            text = _decode(text.encode(true), wrong, "strict")
        back = text
        for true, wrong in reversed(list(zip(steps[::2], steps[1::2]))):
            back = _encode(back, wrong).decode(true)
    except (UnicodeError, LookupError):
        return False
    return text == word and back == original


def evident(mine: DataFrame, found: DataFrame) -> DataFrame:
    """(source, word, original, chain, lossless): the legacy forms of texts in which several whole words are forms of known
    words along one chain.

    As most chains have a reverse, which garbles the garbled word back, the text must also look less clean than its
    restored form: more of its words are odd or, at a tie, its words stand in fewer texts than their originals.
    """
    by = F.regexp_replace("chain", ">latin-1$", ">ansi")  # they differ in control characters only
    odd = F.col("word").rlike(ODD).cast("int") - F.col("original").rlike(ODD).cast("int")
    forms = found.where(~F.col("chain").startswith("utf-8") & (F.col("garbled") != LOST)).withColumnRenamed("garbled", "word")
    forms = stored(forms.withColumns({"by": by, "odder": odd, "rarer": F.col("n_original") - F.col("n")}))
    # what a text shows needs a word that speaks for it; clean texts, whose words are forms of garbled ones, have none
    speaks = forms.where((F.length("word") >= EVIDENCE_LENGTH) & ((F.col("odder") > 0) | (F.col("odder") == 0) & (F.col("rarer") > 0)))
    asked = stored(mine.where("whole").select("source", "word").join(speaks.select("word", "by").distinct(), "word").select("source", "by").distinct())
    own = mine.select("source", "word", "whole").join(asked.select("source").distinct(), "source", "left_semi").distinct()
    own = stored(own.join(forms, "word").join(asked, ["source", "by"], "left_semi"))
    texts = own.where(F.col("whole") & (F.length("word") >= EVIDENCE_LENGTH)).groupBy("source", "by").agg(
        F.countDistinct("word").alias("k"), F.sum("odder").alias("odder"), F.sum("rarer").alias("rarer")
    )
    sure = texts.where((F.col("k") >= EVIDENCE) & ((F.col("odder") > 0) | (F.col("odder") == 0) & (F.col("rarer") > 0))).select("source", "by")
    best = F.max(F.struct(F.col("lossless").cast("int"), "n_original", "original", "chain", "lossless")).alias("b")
    return own.join(sure, ["source", "by"]).groupBy("source", "word").agg(best, F.max("n").alias("n")).select("source", "word", "b.original", "b.chain", "b.lossless", "n")


def short_forms(mine: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``found`` whose form has two characters and an original in ``SHORT_RATIO`` times as many texts. One that
    could be a word, of letters only, must never stand beside its original."""
    legacy = ~F.col("chain").startswith("utf-8") & ~F.col("garbled").contains(LOST)
    short = found.where(legacy & (F.length("garbled") == 2) & (F.col("n_original") >= SHORT_RATIO * F.col("n")))
    letters = short.where(~F.col("garbled").rlike(SYMBOL))
    own = mine.select("source", "word")
    held = own.join(letters.select(F.col("garbled").alias("word"), "original").distinct(), "word").distinct()
    beside = own.withColumnRenamed("word", "original").join(letters.select("original").distinct(), "original", "left_semi")
    both = held.join(beside, ["source", "original"], "left_semi").select(F.col("word").alias("garbled"), "original").distinct()
    return short.where(F.col("garbled").rlike(SYMBOL)).unionByName(letters.join(both, ["garbled", "original"], "left_anti"))


def garbled_words(vocabulary: DataFrame, found: DataFrame, shown: DataFrame, short: DataFrame) -> DataFrame:
    """(word, original, chain, lossless) of the words of ``vocabulary`` (word, n) that are garbled; one row per word.

    ``found`` is their garbled table with ``n``; ``shown`` are words that texts show to be garbled, ``short`` the rows of short forms that count. A form of UTF-8 bytes
    counts as soon as its original is known, as one character became several. A form of a legacy encoding, or one that
    dropped characters, counts where it is three characters long or more and its original stands in ``RATIO`` times as
    many texts, or where most texts that hold it show it (a short form elsewhere may come from another character, so it is
    not restored there). Runs that no known word explains count where they fall into
    garbled forms of the corpus's characters. Among several originals the one in most texts is taken that is not garbled itself.
    """
    direct = F.col("chain").startswith("utf-8") & (F.col("chain") != WITHOUT) & ~F.col("chain").endswith("ignored")
    long_cut = (F.col("chain") == WITHOUT) & (_foreign("garbled") >= 6)
    rare = (F.length("garbled") >= 3) & (F.col("n_original") >= RATIO * F.col("n"))
    counted = found.where((direct & (F.length("garbled") >= 2)) | long_cut | rare | (F.col("garbled") == LOST))
    most = shown.groupBy("word", "original").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n")).where("2 * k >= n").select(F.col("word").alias("garbled"), "original")
    promoted = found.join(most, ["garbled", "original"], "left_semi").withColumn("lossless", F.col("lossless") & (F.length("garbled") >= EVIDENCE_LENGTH))
    hits = stored(counted.unionByName(short).unionByName(promoted).distinct())
    known = hits.select(F.col("garbled").alias("original"), F.lit(1).alias("bad")).distinct()
    order = F.struct(F.when(F.col("bad").isNull(), 1).otherwise(0), F.col("lossless").cast("int"), "n_original", "original", "chain", "lossless")
    best = hits.join(known, "original", "left").groupBy(F.col("garbled").alias("word")).agg(F.max(order).alias("b")).select("word", "b.original", "b.chain", "b.lossless")

    plain = ~F.col("word").rlike("[\\x{80}-\\x{9f}\\x{e000}-\\x{f8ff}\\x{fffd}]")
    letters = vocabulary.where(plain).select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct()
    characters = {r.c for r in letters.collect() if r.c and not r.c.isascii()} | set(TYPOGRAPHIC)  # bounded by Unicode
    forms = vocabulary.sparkSession.sparkContext.broadcast(character_forms(characters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = {c: max(map(len, k), default=0) for c, k in forms.value.items()}
        begins = {c: {f[0] for f in k} for c, k in forms.value.items()}
        for batch in batches:
            out = []
            for word in batch.column(0).to_pylist():
                got = cut_run(word, forms.value, longest, begins)
                if got is not None:
                    out.append((word, got[0], got[1], garbles_to(got[0], got[1], word)))
            cols = list(zip(*out)) or [()] * 4
            kinds = [pa.string(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["word", "original", "chain", "lossless"])

    runs = vocabulary.where(~F.col("word").rlike("[\\x{00}-\\x{7f}]")).join(best, "word", "left_anti").select("word")
    return best.unionByName(runs.mapInArrow(run, "word string, original string, chain string, lossless boolean"))


def find_garbled(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(*key, word, original, chain, lossless): the garbled words of each document; documents without any give no row.

    Null, empty and ASCII texts have none. Repeated keys are one document; other columns are ignored.
    """
    mine = stored(document_words(docs, key, text))
    vocabulary = stored(mine.select("word", "source").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    found = stored(garbled_table(vocabulary).join(vocabulary.select(F.col("word").alias("garbled"), "n"), "garbled"))
    shown = stored(evident(mine, found))
    bad = stored(garbled_words(vocabulary, found, shown, short_forms(mine, found)))
    # short legacy forms, and words that are clean in most other texts, follow their own text
    sure = (F.length("word") >= EVIDENCE_LENGTH) | F.col("chain").startswith("utf-8")
    here = shown.join(bad.where(sure), "word", "left_anti").drop("n").withColumn("own", F.lit(1))
    every = mine.select("key", "word").join(bad.withColumn("own", F.lit(0)), "word").unionByName(mine.select("key", "word", "source").join(here, ["source", "word"]).drop("source"))
    one = every.groupBy("key", "word").agg(F.max(F.struct("own", "original", "chain", "lossless")).alias("b"))
    return one.select(F.col("key").alias(key), "word", "b.original", "b.chain", "b.lossless")


def restore(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(*key, restored, n_words, n_lost, complete) of the affected documents.

    Garbled words are replaced by their originals, longest first, where garbling the original gives exactly the word;
    lossy words stay as they are and are counted in ``n_lost``; ``complete`` is true where nothing was lost.
    """
    found = find_garbled(docs, key, text)
    per = found.groupBy(key).agg(
        F.collect_list(F.when(F.col("lossless"), F.struct("word", "original"))).alias("swaps"),  # as many as a document has words
        F.count(F.lit(1)).alias("n_words"),
        F.sum((~F.col("lossless")).cast("bigint")).alias("n_lost"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, swaps in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                table = {s["word"]: s["original"] for s in swaps}
                if table:
                    t = re.sub("|".join(re.escape(w) for w in sorted(table, key=lambda w: (-len(w), w))), lambda m: table[m.group()], t)
                out.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), batch.column(3), batch.column(4)], names=["key", "restored", "n_words", "n_lost"])

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key), F.col(text).alias("_text")).join(per, key).select(F.col(key).alias("key"), "_text", "swaps", "n_words", "n_lost")
    made = rows.mapInArrow(run, f"key {kind}, restored string, n_words bigint, n_lost bigint")
    return made.select(F.col("key").alias(key), "restored", "n_words", "n_lost", (F.col("n_lost") == 0).alias("complete"))
