"""Personal information inside free text (problem 1).

Structured kinds (EMAIL, PHONE, ID_NUMBER, ADDRESS) have shapes and cue words.
Names have not, so how strongly a term discloses a person is estimated from the
whole corpus, by co-occurrence:

1. Every capitalised word is counted together with its frame, the token(s)
   before it.  A frame's disclosure is the share of words behind it that are
   known names (a list of names, incomplete as it may be).
2. A term's disclosure is the information, in bits, that its occurrence gives
   about a person: log2 of the mean disclosure of its frames against the
   corpus-wide share of names.  Terms over the threshold are protected
   wherever they stand; terms that are common words too (``rose``, ``mark``)
   only beside another name or in a disclosing frame.
3. Protected terms, with the initials and hyphens around them, make up
   mentions; titles and genitive endings stay outside.

Identity numbers are estimated likewise: a frame's disclosure is the share of
numbers behind it that have the shape of an identity number; behind a frame
that discloses them, numbers of any other shape are taken too.

Every mention is replaced by a placeholder of its type; all else is kept.

The tables of terms and frames grow with the vocabulary; they are broadcast
after a check of their size.  Beyond it the terms, or frames, are joined to the
texts that hold them.

Defined results
---------------
* null text: no finding, redacted to null; empty and blank text: no finding;
* repeated rows of an id: found once, redacted once per row;
* overlapping findings: the kind that comes first in KINDS; of one kind the longer;
* placeholders in the text: kept, never part of a finding;
* very long texts: whole;
* empty tables, empty list of names: structured kinds only;
* further columns of the input, whatever their names, are not touched.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm import pii_patterns as P
from veilwork.llm.workers import kept
from veilwork.runtime import stage

KINDS = ["EMAIL", "ADDRESS", "ID_NUMBER", "PHONE", "NAME"]
_first = itemgetter(0)
_LETTERS = re.compile(r"[^\W\d_]{2,}")
_LOWER = re.compile(r"[a-zà-öø-ÿ](?<![^\W_].)[a-zà-öø-ÿ]{2,}(?![^\W_])")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ](?<![@.+\w].)[^\W\d_]{2,}(?![\w@]|\.\w)")
_TOWN = re.compile(r"[,\n]\s*([A-ZÀ-ÖØ-Þ][^\W\d_]{2,})\s\d{5}(?!\d)")
_INITIALS_BEFORE = re.compile(r"(?<![\w./])((?:[A-ZÀ-ÖØ-Þ]\.[ \t]?){1,3})\s*$")
_INITIALS_BEHIND = re.compile(r"\s(?:[A-ZÀ-ÖØ-Þ]\.){2,3}(?![^\W\d_])")
_COMMA = re.compile(r",\s{1,2}")
_GLUE = {"_", "@"}
_GOES_ON = re.compile(r"\s[^\W\d_]")
_BETWEEN = re.compile(r"\s+(?:[A-ZÀ-ÖØ-Þ]\.\s*){0,3}")


def frame(text: str, s: int) -> str:
    """What stands before a word: the token before it, with a mark behind that token; before a short token its mark or word too.

    Numbers are alike, and so are words of more than twelve letters that end a sentence.
    """
    parts = text[max(0, s - 32) : s].rsplit(None, 2)
    if not parts:
        return "^"
    last = parts[-1].lower()
    mark = "" if last[-1].isalnum() else last[-1]
    word = last[:-1] if mark else last
    if not word:
        return mark
    if not word.isalpha():
        cut = len(word)
        while cut and word[cut - 1].isalpha():
            cut -= 1
        word = word[cut:] or ("9" if word[-1].isdigit() else word[-1])
    if len(word) <= 3 and not mark and len(parts) > 1:
        before = parts[-2][-1]
        if not before.isalnum():
            word = f"{before} {word}"
    return f"{word} {mark}" if mark else word


def numbers(text: str):
    """(start, end) of runs of digits that can be identity numbers, dates not."""
    for run in P.DIGIT_RUN.finditer(text):
        s, e = run.span()
        if not (e - s < 14 and P.DATE_ALONE.fullmatch(text, s, e)):
            yield s, e


def number_frame(text: str, s: int) -> str:
    """Frame of a number, apart from those of words."""
    return f"9 {frame(text, s)}"


def _count(batches):
    """Texts -> counted co-occurrences: F frame word, L lower-case word, T town, N frame and whether an identity number by shape is behind."""
    for b in batches:
        seen: Counter = Counter()
        low: Counter = Counter()
        towns: Counter = Counter()
        behind: Counter = Counter()
        for text in b.column(0).to_pylist():
            seen.update([(frame(text, m.start()), m.group().lower()) for m in _CAPITAL.finditer(text)])
            low.update(_LOWER.findall(text))
            towns.update(_TOWN.findall(text))
            for s, e in numbers(text):
                m = P.NUMBERS.match(text[max(0, s - 1) : e + 18].lower(), min(s, 1))
                behind[number_frame(text, s), "1" if m and m.lastgroup != "phone" else "0"] += 1
        rows = [("F", f, w, n) for (f, w), n in seen.items()] + [("L", "", w, n) for w, n in low.items()] + [("T", "", w.lower(), n) for w, n in towns.items()] + [("N", f, w, n) for (f, w), n in behind.items()]
        yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.string()) for k in range(3)), pa.array([r[3] for r in rows], pa.int64())], ["what", "frame", "word", "n"])


class Disclosure:
    """``terms`` (term, bits, role, common) and ``frames`` (frame, share) of a corpus.

    A term that gives ``threshold`` of the most information a term can give
    (that of a sure name, -log2 of the share of names) joins the known names,
    and the frames are weighed again, ``rounds`` times.  A term's own occurrences never count as
    evidence for it.  A term of fewer than ``support`` occurrences joins them if
    all of these stand in sure frames.
    """

    def __init__(self, texts: DataFrame, text_col: str, names: DataFrame, threshold: float = 0.45, support: int = 3, rounds: int = 2):
        counted = texts.select(F.col(text_col).alias("t")).where("t IS NOT NULL").mapInArrow(_count, "what string, frame string, word string, n long")
        table = stage(counted.groupBy("what", "frame", "word").agg(F.sum("n").alias("n")))
        listed = names.select(F.lower("term").alias("word"), F.upper("category").alias("category")).where("category IN ('GIVEN_NAME', 'SURNAME')")
        listed = listed.groupBy("word").agg(F.min("category").alias("category"))
        pairs = table.where("what = 'F'").select("frame", "word", "n")
        words = pairs.groupBy("word").agg(F.sum("n").alias("total")).join(table.where("what = 'L'").select("word", F.col("n").alias("low")), "word", "left")
        words = words.join(listed, "word", "full_outer").select("word", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("low", F.lit(0)).alias("low"), "category")
        known = stage(words.withColumn("common", F.col("low") > F.col("total")).withColumn("name", F.col("category").isNotNull() & ~F.col("common")))
        base = known
        for _ in range(rounds):
            marked = pairs.join(known.select("word", "name", "total"), "word")
            hits = F.sum(F.when(F.col("name"), F.col("n")).otherwise(0))
            shares = stage(marked.groupBy("frame").agg(F.sum("n").alias("of"), hits.alias("hits")))
            sums = shares.agg(F.sum("of").alias("of"), F.sum("hits").alias("hits")).first()
            prior = max((sums["hits"] or 0) / max(1, sums["of"] or 0), 1e-9)
            own = F.when(F.col("name"), F.col("n")).otherwise(0)
            share = (F.col("hits") - own) / (F.col("of") - F.col("n") + 2)
            sure = F.when((F.col("of") - F.col("n") >= 4 * support) & (share >= 0.8), F.col("n")).otherwise(0)
            weighed = marked.join(shares, "frame").groupBy("word").agg((F.sum(F.col("n") * share) / F.sum("n")).alias("p"), F.sum(sure).alias("disclosed"))
            bits = F.log2(F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(1e-9)) / F.lit(prior))
            scored = base.drop("name").join(weighed, "word", "left").withColumn("bits", bits)
            over = (F.col("bits") >= F.lit(-threshold * math.log2(prior))) & ((F.col("total") >= support) | (F.col("disclosed") >= F.col("total")))
            known = stage(scored.withColumn("name", ~F.col("common") & (F.col("category").isNotNull() | over)))
        self.prior = prior
        # names are no frames here (a mention beside a name is found by its neighbour)
        cues = shares.join(known.where("name").select(F.col("word").alias("frame")), "frame", "left_anti")
        self.frames = stage(cues.select("frame", "of", (F.col("hits") / (F.col("of") + 2)).alias("share")).where((F.col("of") >= 4 * support) & (F.col("share") >= 0.6)).select("frame", "share"))
        # what stands before identity numbers of a known shape discloses numbers of any shape
        told = table.where("what = 'N'").groupBy("frame").agg(F.sum("n").alias("of"), F.sum(F.when(F.col("word") == "1", F.col("n")).otherwise(0)).alias("hits"))
        told = told.select("frame", "of", (F.col("hits") / (F.col("of") + 2)).alias("share")).where((F.col("of") >= 4 * support) & (F.col("share") >= 0.9)).select("frame", "share")
        self.frames = stage(self.frames.unionByName(told))
        # a surname is what often stands behind a name
        forenames = known.where("name").select(F.col("word").alias("frame"))
        behind = pairs.join(forenames, "frame").groupBy("word").agg(F.sum("n").alias("behind"))
        role = F.when(F.col("category") == "GIVEN_NAME", "G").when(F.col("category") == "SURNAME", "S").when(F.col("behind") >= 0.1 * F.col("total"), "S").otherwise("G")
        # a word that discloses only in some of its frames is judged where it stands
        some = ~F.col("name") & ((F.coalesce("disclosed", F.lit(0)) >= F.greatest(F.lit(2 * support), 0.02 * F.col("total"))) | F.col("category").isNotNull())
        some = some & (F.col("category").isNotNull() | (F.col("low") <= 20 * F.col("total")))
        self.terms = stage(known.where(F.col("name") | some).join(behind, "word", "left").select(F.col("word").alias("term"), "bits", role.alias("role"), (~F.col("name")).alias("common")))
        towns = names.where(F.upper("category") == "TOWN").select(F.lower("term").alias("term"))
        self.towns = stage(table.where("what = 'T'").select(F.col("word").alias("term")).unionByName(towns).distinct())


def lowered(text: str) -> str:
    """Lower case with unchanged offsets."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


_KEYS: dict[str, str] = {}
for _tag, _words in (("D", P.SPELLED_WORDS), ("0", P.STREET_WORDS[0]), ("1", P.STREET_WORDS[1]), ("2", P.STREET_WORDS[2]), ("C", P.CUE_WORDS), ("N", P.NOTE_WORDS)):
    for _w in _words:
        _KEYS[_w] = _KEYS.get(_w, "") + _tag


def vocabulary(terms) -> dict[str, tuple[str, bool, str]]:
    """word -> (role, common, tags): protected terms and the words that lead to structured findings."""
    return {w: (*terms.get(w, ("", False)), _KEYS.get(w, "")) for w in {*terms, *_KEYS}}


def _around(low: str, done: int, s: int, e: int) -> tuple[int, int]:
    """Bounds of what a street can take up around its word at [s, e): six words before, twelve behind, however long they are."""
    left, right = max(done, s - 64), min(len(low), e + 90)
    while left > done and len(low[left:s].split(None, 6)) < 7:
        left = max(done, left - 64)
    while right < len(low) and len(low[e:right].split(None, 12)) < 13:
        right = min(len(low), right + 90)
    return left, right


def _long_street(text: str, tag: int, done: int, s: int, right: int):
    """A street whose name has more capitalised words than the common shape takes, or None."""
    if tag < 2:
        left = max(done, s - 16)
        return P.LONG_STREETS[tag].search(text, left, right if tag == 0 else len(text)) if text[s - 1 : s].isspace() or tag == 1 else None
    at, words = s, 0
    while True:
        j = at
        while j > done and text[j - 1].isspace():
            j -= 1
        i = j
        while i > done and not text[i - 1].isspace():
            i -= 1
        word = text[i:j]
        if not (word[:1].isupper() or word in P.SMALL) or not word[-1:].isalnum():
            break
        at, words = i, words + 1
    if words < 3 or not word[:1].isdigit():
        return None
    return P.LONG_STREETS[2].search(text, max(done, i - 24), right)


def structured(text: str, low: str, keys: list[tuple[int, int, str]], frames, towns, mask: bytearray) -> list[tuple[int, int, str]]:
    """Findings of the structured kinds, none overlapping.

    ``keys``: places of the words that lead to them; ``mask`` gets a 1 at every
    position that is taken.
    """
    for m in P.PLACEHOLDER.finditer(text) if "[" in text else ():
        mask[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    out: list[tuple[int, int, str]] = []

    def add(s: int, e: int, kind: str) -> None:
        if e > s and mask.find(1, s, e) < 0:
            out.append((s, e, kind))
            mask[s:e] = b"\1" * (e - s)

    def other(s: int) -> bool:
        # the first test is quick, and true wherever the second one is
        return low[max(0, s - 24) : s].rstrip().rstrip("#:").rstrip().endswith(P.REFERENCE_ENDS) and P.REFERENCES.search(low, max(0, s - 24), s) is not None

    def number(m) -> None:
        if m and sum(c.isdigit() for c in m.group()) >= 5:
            add(m.start(), m.end(), "ID_NUMBER")

    for m in P.MAIL_SIGN.finditer(low):
        host = P.MAIL_DOMAIN.match(low, m.end())
        if host:
            at = m.start()
            begin = max(0, at - 80)
            while begin and (low[begin - 1].isalnum() or low[begin - 1] in P.MAIL_INNER):
                begin -= 1  # never from the middle of a local part on
            local = P.MAIL_LOCAL.search(low[begin:at])
            if local and any(c.isalpha() for c in local.group()):
                add(begin + local.start(), host.end(), "EMAIL")
    for tag in "012":
        p, done = P.STREETS[int(tag)], 0
        for s, e, _ in [k for k in keys if tag in k[2]]:
            if s < done:
                continue
            left, right = _around(low, done, s, e)
            m = p.search(low, left, right)
            long = _long_street(text, int(tag), done, s, right)
            if m is None or long and long.start() <= m.start() and long.end() > (m.start("tail") if tag == "2" and m.group("tail") else m.end()):
                m = long
            if m is None:
                continue
            begin = m.start()
            done = e = m.end()
            if tag == "2":
                behind = m.start("tail") if m is not long and m.group("tail") else e
                tail = None if m is not long and m.group("zip") else P.LONG_TAIL.match(text, behind)
                if tail and tail.end() > e:
                    done = e = tail.end()
                    m = long = None
            if m is not long and tag == "2" and m.group("tail") and not m.group("zip"):
                # a place without a postcode must be a known town
                words = _LETTERS.findall(m.group("tail"))
                done = e = m.start("tail")
                if words and words[0] in towns:
                    done = e = m.start("tail") + m.group("tail").index(words[0]) + len(words[0])
            add(begin, e, "ADDRESS")
    for m in P.STREET_END.finditer(low):
        s = m.start()
        while s and (low[s - 1].isalpha() or low[s - 1] == "-"):
            s -= 1
        if s < m.start():
            add(s, m.end(), "ADDRESS")
    for m in P.ID_LETTERED.finditer(text):
        if not other(m.start()):
            add(m.start(), m.end(), "ID_NUMBER")
    spelled = 0
    for s, _, tags in keys:
        if "C" in tags:
            m = P.ID_CUE.match(low, s)
            shaped = m and P.NUMBERS.match(low, m.end())
            number(shaped if shaped and shaped.lastgroup == "whole" else m and P.ID_BEHIND.match(text, m.end()))
        if "N" in tags and low[s - 1 : s] == "(" and P.ID_NOTE.match(low, s - 2):
            number(P.ID_BEFORE.search(text, max(0, s - 26), s - 2))
        spelled += "D" in tags
    for s, e in numbers(text):
        for m in P.NUMBERS.finditer(low, s, min(len(text), e + 18)):
            if m.start() < e and not other(m.start()):  # what begins behind the run belongs to the next one
                add(m.start(), m.end(), "PHONE" if m.lastgroup == "phone" else "ID_NUMBER")
        if mask.find(1, s, e) < 0 and number_frame(text, s) in frames and not other(s):
            number(P.ID_BEHIND.match(text, s))
    if spelled >= 7:  # the least a spelled number has
        for m in P.SPELLED.finditer(low):
            add(m.start(), m.end(), "PHONE")
    return out


def _is_title_m(text: str, at: int) -> bool:
    """Whether ``M.`` at this place is the French title, by the words around it."""
    near = text[max(0, at - 150) : at + 150]
    return len(P.FRENCH.findall(near)) > len(P.OTHER.findall(near))


def mentions(text: str, hits: list[tuple[int, int, tuple]], mask: bytearray, vocab, frames) -> list[tuple[int, int, str]]:
    """Name mentions outside ``mask``; ``hits``: places of protected terms."""

    def free(s: int, e: int) -> bool:
        return mask.find(1, s, e) < 0

    found = []
    for s, e, v in hits:
        if v[0] and free(s, e) and text[e : e + 1] not in _GLUE and text[s - 1 : s] not in _GLUE and not text[e : e + 1].isdigit():
            found.append((s, e, v[0], v[1]))
    if not found:
        return []
    # a common word counts beside a sure name or in a disclosing frame
    sure = []
    for i, (s, e, role, common) in enumerate(found):
        if common:
            nxt = found[i + 1] if i + 1 < len(found) else None
            beside = nxt is not None and not nxt[3] and nxt[2] == "S" and _BETWEEN.fullmatch(text, e, nxt[0])
            if not beside and role == "S" and i and not found[i - 1][3]:
                beside = _BETWEEN.fullmatch(text, found[i - 1][1], s)
            if not beside and role == "G" and i and found[i - 1][2] == "S" and not found[i - 1][3] and text[s].isupper():
                # surname, given name
                beside = _COMMA.fullmatch(text, found[i - 1][1], s) and not _GOES_ON.match(text, e)
            if not beside:
                f = frame(text, s)
                # a frame that is a common word itself says nothing of a lower-case word
                beside = frames.get(f, 0) >= 0.9 and (text[s].isupper() or not vocab.get(f, ("", False))[1])
            if not beside:
                continue
        sure.append((s, e, role))
    runs: list[list] = []
    for s, e, role in sure:
        if runs:
            r = runs[-1]
            gap = text[r[1] : s]
            last = r[2][-1]
            if gap == "-" and last == role:
                r[1], joined = e, True
            elif _BETWEEN.fullmatch(gap) and last == "G" and role == "S":
                r[1], joined = e, True
                r[2] += "S"
            elif gap.startswith(",") and gap[1:].isspace() and r[2] == "S" and role == "G" and "\n\n" not in gap:
                r[1], joined = e, True
                r[2] += "g"
            elif _BETWEEN.fullmatch(gap) and r[2][-1] == "g" and role == "S":
                joined = False
            else:
                joined = False
            if joined:
                continue
        runs.append([s, e, role])
    out = []
    for s, e, roles in runs:
        m = _INITIALS_BEFORE.search(text, max(0, s - 12), s)
        if m and roles[0] == "S" or m and roles[0] == "G":
            at = m.start(1)
            if m.group(1).startswith("M.") and _is_title_m(text, at):
                at += len(re.match(r"M\.\s*", text[at:s]).group())
            prior = text[max(0, at - 9) : at].rstrip().lower()
            if not prior.endswith(("vitamin", "vitamine", "vitamina", "hepatitis")) and free(at, s):
                s = at
        if "G" not in roles and "g" not in roles:
            m = _INITIALS_BEHIND.match(text, e)
            if m:
                e = m.end()
        if free(s, e):
            out.append((s, e, "NAME"))
    return out


def _letter(c: str) -> bool:
    """Whether ``c`` is what words consist of, as in ``_LETTERS``."""
    return c.isalnum() and not c.isdecimal()


def _places(low: str, vocab) -> list[tuple[int, int, tuple]]:
    """(start, end, entry) of the words of ``low`` that are in ``vocab``, in order."""
    out = []
    # it is faster to look for the few words that a text has than to look every word up
    for w in vocab.keys() & set(_LETTERS.findall(low)):
        v, n, at = vocab[w], len(w), low.find(w)
        while at >= 0:
            e = at + n
            if not (_letter(low[at - 1 : at]) or _letter(low[e : e + 1])):
                out.append((at, e, v))
            at = low.find(w, e)
    return sorted(out, key=_first)


def find(text: str, vocab, frames, towns) -> list[tuple[int, int, str]]:
    """All findings of one text, in order; ``vocab`` as of :func:`vocabulary`."""
    if not text or text.isspace():
        return []
    low = lowered(text)
    hits = _places(low, vocab)
    mask = bytearray(len(text))
    taken = structured(text, low, [(s, e, v[2]) for s, e, v in hits if v[2]], frames, towns, mask)
    return sorted(taken + mentions(text, hits, mask, vocab, frames))


def _unpack(b, fixed):
    """The vocabulary of each row: the broadcast one, or the row's own terms and frames."""
    terms, frames, towns = fixed.value
    names = b.schema.names
    cues = [{x["frame"]: x["share"] for x in own or []} for own in b.column("cues").to_pylist()] if "cues" in names else [frames] * b.num_rows
    if "own" not in names:
        vocab = kept(("vocabulary", id(terms)), lambda: (vocabulary(terms), terms))[0]
        return [(vocab, c, towns) for c in cues]
    return [(vocabulary({x["term"]: (x["role"], x["common"]) for x in own or [] if x["role"] != "T"}), c, {x["term"] for x in own or [] if x["role"] == "T"}) for own, c in zip(b.column("own").to_pylist(), cues, strict=True)]


def _held(what):
    """(key, text) -> (key, item) of what a text holds."""

    def run(batches):
        for b in batches:
            keys, items = [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                mine = what(text)
                keys += [key] * len(mine)
                items += mine
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(items, pa.string())], ["_key", "item"])

    return run


def _frames_of(text: str) -> set[str]:
    return {frame(text, m.start()) for m in _LETTERS.finditer(lowered(text))} | {number_frame(text, s) for s, _ in numbers(text)}


def _words_of(text: str) -> set[str]:
    return set(_LETTERS.findall(lowered(text)))


def _find_rows(fixed):
    def run(batches):
        for b in batches:
            row, start, end, kind = [], [], [], []
            for i, (text, v) in enumerate(zip(b.column(1).to_pylist(), _unpack(b, fixed), strict=True)):
                for s, e, k in find(text, *v):
                    row.append(i)
                    start.append(s)
                    end.append(e)
                    kind.append(k)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(kind, pa.string())], ["id", "start_idx", "end_idx", "kind"])

    return run


def _redact_rows(fixed):
    def run(batches):
        for b in batches:
            out = []
            for text, v in zip(b.column(1).to_pylist(), _unpack(b, fixed), strict=True):
                if text is not None:
                    for s, e, k in reversed(find(text, *v)):
                        text = f"{text[:s]}[{k}]{text[e:]}"
                out.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["id", "redacted"])

    return run


class Sanitiser:
    """Finds and replaces personal information with the vocabulary of a corpus."""

    def __init__(self, disclosure: Disclosure, broadcast_terms: int = 300_000, broadcast_frames: int = 100_000):
        spark = disclosure.terms.sparkSession
        self.disclosure = disclosure
        self.joined = disclosure.terms.count() + disclosure.towns.count() > broadcast_terms
        self.joined_frames = disclosure.frames.count() > broadcast_frames
        terms, frames, towns = {}, {}, set()
        if not self.joined:
            terms = {r["term"]: (r["role"], r["common"]) for r in disclosure.terms.collect()}
            towns = {r["term"] for r in disclosure.towns.collect()}
        if not self.joined_frames:
            frames = {r["frame"]: r["share"] for r in disclosure.frames.collect()}
        self.fixed = spark.sparkContext.broadcast((terms, frames, towns))

    def _with_terms(self, rows: DataFrame) -> DataFrame:
        """The rows; with too large a vocabulary, also the terms (``own``) or frames (``cues``) that each text holds."""
        if not self.joined and not self.joined_frames:
            return rows
        d, out = self.disclosure, rows.withColumn("_key", F.md5("text"))
        keyed = out
        if self.joined:
            every = d.terms.select("term", "role", "common").unionByName(d.towns.select("term", F.lit("T").alias("role"), F.lit(False).alias("common")))
            words = keyed.where("text IS NOT NULL").select("_key", "text").mapInArrow(_held(_words_of), "_key string, item string").withColumnRenamed("item", "term").distinct()
            own = words.join(every, "term").groupBy("_key").agg(F.collect_list(F.struct("term", "role", "common")).alias("own"))
            out = out.join(own, "_key", "left")
        if self.joined_frames:
            held = keyed.where("text IS NOT NULL").select("_key", "text").mapInArrow(_held(_frames_of), "_key string, item string").withColumnRenamed("item", "frame").distinct()
            cues = held.join(d.frames, "frame").groupBy("_key").agg(F.collect_list(F.struct("frame", "share")).alias("cues"))
            out = out.join(cues, "_key", "left")
        return out.drop("_key")

    def found(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, start_idx, end_idx, kind) of every finding, distinct."""
        kind = df.schema[id_col].dataType.simpleString()
        rows = self._with_terms(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL"))
        return rows.mapInArrow(_find_rows(self.fixed), f"id {kind}, start_idx int, end_idx int, kind string").distinct()

    def redacted(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, redacted), one row per row of ``df``."""
        kind = df.schema[id_col].dataType.simpleString()
        rows = self._with_terms(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
        return rows.mapInArrow(_redact_rows(self.fixed), f"id {kind}, redacted string")
