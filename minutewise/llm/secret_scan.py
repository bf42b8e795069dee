"""Secrets in texts: three fixed patterns, and guess-cost dynamic programming on values in credential contexts.

A value that follows a credential word ("passwd:", "pin =", a password in a connection address) is taken apart by the
cheapest segmentation into known words, dates, repeats, keyboard walks, runs and brute-force spans, where each segment
costs the logarithm of the guesses it takes; a value whose cheapest segmentation still takes 10**`MIN_LOG10` guesses
is a secret of kind `guess`. Placeholders ("changeme", "xxxxxxxx") and words of a language are cheap and so are left
alone, whatever their case; letters that are no words are not. Words are the frequent passwords below and, if its path is
given, the whole words of a public tokenizer's file, in the order of their ids (which follows frequency). Values have
any length; repeats of blocks of more than `BLOCK` characters are no segments.

Where a value ends: a quoted one (' " `) at its closing quote on the same line, whatever stands inside; any other one at
white space, or before the next `,` `;` or `&` with a name and `=`. Full stops, commas, colons and semicolons at an
unquoted value's end belong to the sentence if the value is as dear without them; other signs belong to the value.
An address is a value only if one of its parts is dear by itself.

Kinds: `assign`, `access`, `hex` by the fixed patterns, all of them, leftmost and non-overlapping for each kind, whole
match, code points; `guess` spans cover the value only, and are left out where fixed spans cover all of it. A value that
fixed spans cover in part has both, and redact() replaces them as one.

Defined results: null and empty texts have no spans; spans that start alike stand in the order of kinds; of guess values
that start alike the shorter is told first, and one that ends within a told one is left out; null ids stay; repeated rows are scanned one by one; extra columns are kept by
redact() and ignored by scan_secrets().
"""

from __future__ import annotations

import bisect
import hashlib
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minutewise.llm.shared import per_worker
from minutewise.llm.token_counts import slices

MIN_LOG10 = 7.0
#: The longest block of a repeat, and the longest value whose cost is kept.
BLOCK, KEPT = 64, 128
KINDS = ("assign", "access", "hex", "guess")
SPANS = "array<struct<kind:string,start:int,end:int,log10_guesses:double>>"

# The base patterns, with the least length inside where that is the same.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

#: Words before a value that make it a credential (several languages), and passwords inside addresses.
NAME = r"""(?<![a-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|pw|pin|secret|token|api[_-]?key|credentials?|auth(?:orization)?|bearer|private[_-]?key|access[_-]?key|contrase(?:ñ|n)a|clave|passwort|kennwort|mot\x20de\x20passe)"""
GAP = r"[ \t]*+(?:\r?\n[ \t]*+)?+"
SIGN = rf"(?:[ \t]+is\b{GAP}[:=]?|{GAP}(?::=|=>|[:=]))"
QUOTED = r"""(?:"([^"\n]+)"|'([^'\n]+)'|`([^`\n]+)`)"""
BARE = r"""["'`]?((?:(?![,;&][ \t]*[A-Za-z_][\w.-]*=)\S)++)"""
CONTEXT = re.compile(rf"""(?i){NAME}["'`]?{SIGN}{GAP}(?:(?:bearer|basic)\x20+)?(?:{QUOTED}|{BARE})""")
BEARER = re.compile(r"(?i)(?<![a-z0-9])bearer\x20+([a-z0-9._~+/=-]++)")
ADDRESS = re.compile(r"""(?i)(?<![a-z0-9+])[a-z][a-z0-9+]{1,15}://[^\s/:@"']*+:([^\s/@"']++)@""")
URL = re.compile(r"(?i)[a-z][a-z0-9+]*://[^@\s]*")
SENTENCE = ".,:;"
#: Names that stand for a value that is put in later.
TEMPLATE = re.compile(r"\$?\{+ ?[A-Za-z_][\w.]* ?\}+|<[A-Za-z_][\w -]*>|\$[A-Z_]+|%[A-Z_]+%")
HINTS = ("pass", "pwd", "pw", "pin", "secret", "token", "key", "credential", "auth", "bearer", "contrase", "clave", "kennwort", "mot de passe", "://")

#: Frequent passwords and words in them, most frequent first: a word's rank is its number of guesses.
COMMON = """password 123456 12345678 qwerty abc123 letmein monkey dragon master welcome login admin princess sunshine
shadow football baseball superman batman trustno1 iloveyou hello freedom whatever secret root toor test guest default
changeme example sample placeholder user username pass passwd token key api apikey access auth private public your my
the insert here replace enter none null undefined true false todo redacted removed hidden value string text name
server system service account manager office home work money love summer winter spring autumn monday friday january
june july august september october november december ninja mustang access pepper cheese computer internet killer
starwars jordan harley ranger buster thomas robert michael daniel jessica ashley nicole andrew joshua matthew hunter
soccer hockey george charlie tigger jennifer orange banana apple cookie chocolate flower purple yellow silver golden
diamond phoenix matrix spider eagle falcon tiger lion bear wolf horse water fire earth wind storm cloud river ocean
mountain forest garden house castle king queen prince knight""".split()
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "qwertzuiop", "azertyuiop")
#: Signs for letters; some stand for two.
LEETS = (str.maketrans("4@8310$57!", "aabeiosstl"), str.maketrans("4@6319$52!(|+", "aagelgsszicl" + "t"))
DATE = re.compile(r"(?:19|20)\d\d(?:[-./]?(?:0[1-9]|1[0-2])(?:[-./]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-./]?(?:0?[1-9]|1[0-2])[-./]?(?:(?:19|20)\d\d|\d\d)")


def whole_words(vocabulary: str) -> list[str]:
    """The words of three letters and more that the vocabulary file holds whole, by id."""
    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model.get("end_of_word_suffix") or ""
    blank = "" if end else "\u0120"  # byte-level vocabularies put a blank's sign before a word
    said = sorted((i, t) for t, i in model["vocab"].items() if t.endswith(end) and t.startswith(blank))
    words = (t[len(blank) : len(t) - len(end)] for _, t in said)
    return [w.lower() for w in words if len(w) > 2 and w.isascii() and w.isalpha()]


class GuessCost:
    """Minimum-cost segmentation; costs are log10 of guesses."""

    def __init__(self, vocabulary: str | None = None) -> None:
        self.words = {}
        for rank, word in enumerate(dict.fromkeys([*COMMON, *(whole_words(vocabulary) if vocabulary else [])]), 1):
            self.words[word] = math.log10(rank + 1)
        self.longest = max(map(len, self.words))
        self.next_to = set()
        for row in ROWS:
            self.next_to |= set(zip(row, row[1:], strict=False)) | set(zip(row[1:], row, strict=False))
        self.seen: dict[str, float] = {}

    @staticmethod
    def alphabet(text: str) -> int:
        n = 26 * any("a" <= c <= "z" for c in text) + 26 * any("A" <= c <= "Z" for c in text) + 10 * any("0" <= c <= "9" for c in text)
        return max(2, n + 33 * any(c.isascii() and not c.isalnum() for c in text) + 100 * any(not c.isascii() for c in text))

    def segments(self, text: str) -> Iterator[tuple[int, int, float]]:
        """(start, end, cost) of every pattern in the text; brute force is added by cost()."""
        low = text.lower()
        if len(low) != len(text):  # a letter that becomes two
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        forms = [(low, 0.0), *((f, 0.5) for f in dict.fromkeys(low.translate(t) for t in LEETS) if f != low)]
        n = len(text)
        for i in range(n):
            for j in range(i + 2, min(n, i + self.longest) + 1):
                for form, extra in forms:
                    cost = self.words.get(form[i:j])
                    if cost is not None:
                        part = text[i:j]
                        upper = sum(c.isupper() for c in part)
                        yield i, j, cost + extra + (0.3 * bool(upper) if upper in (0, len(part)) or part[0].isupper() and upper == 1 else 0.3 * upper)
                        break
        for m in DATE.finditer(text):
            yield m.start(), m.end(), math.log10(365 * 120) if m.end() - m.start() > 4 else math.log10(120)
        # Runs: neighbours on the keyboard, or in the alphabet with one step.
        i = 0
        while i < n - 2:
            j = i + 1
            while j < n and (low[j - 1], low[j]) in self.next_to:
                j += 1
            if j - i >= 3:
                yield i, j, math.log10(40 * 4 * (j - i))
            step = ord(low[i + 1]) - ord(low[i])
            k = i + 1
            while k < n and abs(step) <= 1 and ord(low[k]) - ord(low[k - 1]) == step:
                k += 1
            if k - i >= 3:
                yield i, k, math.log10(30 * (k - i))
            i = max(i + 1, max(j, k if k - i >= 3 else 0) - 1)

    def cost(self, text: str, blocks: dict[str, float] | None = None) -> float:
        """log10 of the guesses for a value of any length, in steps that grow with its length only.

        blocks: the costs of the repeated blocks met in this value, each taken apart once.
        """
        if text in self.seen:
            return self.seen[text]
        blocks = {} if blocks is None else blocks
        if text in blocks:
            return blocks[text]
        n = len(text)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for i, j, c in self.segments(text):
            ending[j].append((i, c))
        letter = math.log10(self.alphabet(text))
        best = [0.0] + [math.inf] * n
        #: For each block size, how many characters before j equal those so many places before.
        same = [0] * (BLOCK + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1] + letter
            for i, c in ending[j]:
                best[j] = min(best[j], best[i] + c)
            # Repeats: the stretch before j is one block, two times or more; it costs the block and its count.
            for size in range(1, min(j - 1, BLOCK) + 1):
                same[size] = same[size] + 1 if text[j - 1] == text[j - 1 - size] else 0
                if same[size] >= size:
                    times = 1 + same[size] // size
                    start = j - size * times
                    block = min(size * letter, self.cost(text[start : start + size], blocks))
                    best[j] = min(best[j], best[start] + block + math.log10(times))
        blocks[text] = best[n]
        if n <= KEPT and len(self.seen) < 100_000:
            self.seen[text] = best[n]
        return best[n]


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, order of kind, end) of the base patterns' matches, sorted."""
    found = []
    low = text.lower()
    if "password" in low or "passwd" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def covers(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the sorted spans cover together."""
    starts: list[int] = []
    ends: list[int] = []
    for a, _, z in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], z)
        else:
            starts.append(a)
            ends.append(z)
    return starts, ends


def bare_end(text: str, a: int, z: int, guesses: GuessCost, least: float) -> int:
    """An unquoted value's end: without the sentence's last signs if what is left is a secret as well, or if the whole is none."""
    short = z
    while short > a and text[short - 1] in SENTENCE:
        short -= 1
    if short == z or short == a:
        return short
    return z if guesses.cost(text[a:z]) >= least > guesses.cost(text[a:short]) else short


def all_spans(text: str, guesses: GuessCost, least: float = MIN_LOG10) -> list[tuple[int, int, int, float | None]]:
    """(start, order of kind, end, log10 of guesses) of every span, sorted."""
    base = fixed_spans(text)
    spans: list[tuple[int, int, int, float | None]] = [(*s, None) for s in base]
    low = text.lower()
    if any(h in low for h in HINTS):
        values = {}
        for p in (CONTEXT, ADDRESS, BEARER):
            for m in p.finditer(text):
                values[m.span(m.lastindex)] = values.get(m.span(m.lastindex), False) or (p is CONTEXT and m.lastindex <= 3)
        starts, ends = covers(base)
        taken = -1
        for (a, z), quoted in sorted(values.items()):
            if not quoted:
                z = bare_end(text, a, z, guesses, least)
            at = bisect.bisect_right(starts, a) - 1
            if z <= taken or z <= a or (at >= 0 and z <= ends[at]):
                continue
            value = text[a:z]
            if TEMPLATE.fullmatch(value):
                continue
            cost = guesses.cost(value)
            inside = ADDRESS.match(value)
            if cost >= least and (inside or URL.fullmatch(value)):
                # An address's own password is a value by itself; here only its other parts count.
                parts = re.split(r"[/?&=#.:]+", value[inside.end() :] if inside else value)
                cost = max((guesses.cost(part) for part in parts if part), default=0.0)
            if cost >= least:
                spans.append((a, 3, z, cost))
                taken = z
    return sorted(spans, key=lambda s: s[:3])


def scan_secrets(docs: DataFrame, least: float = MIN_LOG10, vocabulary: str | None = None) -> DataFrame:
    """doc_id, spans (kind, start, end, log10_guesses), by start and kind. vocabulary: a tokenizers file with words."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesses = per_worker(f"guesses {vocabulary}", lambda: GuessCost(vocabulary))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("log10_guesses", pa.float64())]))
        for b in batches:
            for s in slices(b):
                spans = [[{"kind": KINDS[k], "start": a, "end": z, "log10_guesses": c} for a, k, z, c in all_spans(t, guesses, least)] if t else [] for t in s.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scanned, f"doc_id long, spans {SPANS}")


def redact(docs: DataFrame, mark: str = "[secret]", least: float = MIN_LOG10, length: str | None = "n_chars", vocabulary: str | None = None) -> DataFrame:
    """The documents with every secret replaced by `mark`; all columns stay, `length` (if it is there) is counted anew.

    A null text stays null. Overlapping spans are replaced as one.
    """
    schema = docs.schema
    names = docs.columns
    at = names.index("text")
    counted = names.index(length) if length in names else -1

    def covered(text: str, guesses: GuessCost) -> str:
        out, upto = [], 0
        for a, _, z, _ in all_spans(text, guesses, least):
            if a >= upto:
                out += [text[upto:a], mark]
            upto = max(upto, z)
        return "".join([*out, text[upto:]]) if out else text

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesses = per_worker(f"guesses {vocabulary}", lambda: GuessCost(vocabulary))
        for b in batches:
            for s in slices(b):
                columns = list(s.columns)
                old = columns[at].to_pylist()
                new = [covered(t, guesses) if t else t for t in old]
                columns[at] = pa.array(new, columns[at].type)
                if counted >= 0:
                    n = [k if t is u else len(t) for k, t, u in zip(columns[counted].to_pylist(), new, old, strict=True)]
                    columns[counted] = pa.array(n, columns[counted].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(changed, T.StructType(schema.fields))


def secrets_query(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    told = lambda kinds: F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scan_secrets(docs, vocabulary=vocabulary).select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(told(list(KINDS[:3])).cast("binary"), 256).alias("base_sha256"),
        told(list(KINDS)).alias("spans"),
    )


def base_digest(text: str | None) -> str:
    """The base spans' digest of one text, for tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in fixed_spans(text or "")).encode()).hexdigest()
