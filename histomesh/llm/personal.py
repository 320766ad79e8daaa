"""Personal data in text: fixed patterns, and spans added by a semi-Markov conditional random field.

The field scores whole candidate segments of up to ``LONGEST`` tokens: their shape, lengths,
checksums and surroundings. Dynamic programming over the tokens of a zone then chooses
boundaries and types of all segments together. Zones are the stretches of whole tokens around
digits, ``@`` and words of ``LETTERS`` or more ASCII letters; elsewhere every token is outside with score 0, so nothing needs to be computed there.
A zone grows with its text, a segment does not: work is linear in the text, and of a token no
more is held than where it lies and one step back for each kind.

The field is trained here: kinds of data are generated and planted into clean stretches of a
bounded sample of the corpus, beside look-alikes that are none (versions, dates, amounts,
failed checksums), and the likelihood of the right segmentation is raised by gradient steps
on the forward and backward sums over all segmentations.
"""

from __future__ import annotations

import random
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histomesh.llm.words import utf8

KINDS = ("email", "ip", "card", "phone", "secret", "iban", "ssn")
BASE = KINDS[:4]
OUTSIDE = len(KINDS)
LONGEST, ROOM = 16, 40
SCORED = 2048
BUCKETS = 1 << 14

# The patterns of the four base kinds.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
LETTERS = 16
_MARK = re.compile("[0-9@]")
_ANCHOR = re.compile(r"[0-9@]|(?<![^\W_])[A-Za-z]{%d,}" % LETTERS)
_REST = re.compile(r"[^\W_]*")
_DIGITS = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Whether an account number's check digits are right."""
    code = code.upper()
    turned = code[4:] + code[:4]
    return turned.isalnum() and turned.isascii() and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            end = domain.end()
            yield start, end
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) of all base matches that hold, by start, then kind.

    The dot and digit runs of an address, and the digits of a card, never give anything back
    to a match, so possessive runs find the same matches without backtracking.
    """
    found = [(a, b, 0) for a, b in _emails(text)]
    found += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if _octets(m.group())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _DIGITS.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_DIGITS.sub("", m.group())) <= 15:
            found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def _word(c: str) -> bool:
    return c.isalnum()


def _long(text: str, start: int, end: int) -> bool:
    """Whether a token is as long as a secret and of ASCII letters only."""
    return end - start >= LETTERS and text[start:end].isascii() and text[start:end].isalpha()


class Run(Sequence):
    """Spans of tokens, held as plain numbers."""

    def __init__(self):
        self.ends = array("q")

    def __len__(self) -> int:
        return len(self.ends) // 2

    def __getitem__(self, k: int) -> tuple[int, int]:
        k = k + len(self) if k < 0 else k
        return self.ends[2 * k], self.ends[2 * k + 1]


def zones(text: str, taken: list[tuple[int, int]]) -> Iterator[Run]:
    """Spans of whole tokens of each stretch around anchors, cut where ``taken`` spans lie."""
    at, n, k = 0, len(text), 0
    while anchor := _ANCHOR.search(text, at):
        start, end = max(at, anchor.start() - ROOM), anchor.end()
        while (more := _ANCHOR.search(text, end, end + ROOM)) is not None:
            end = more.end()
        while at < start < n and _word(text[start]) and _word(text[start - 1]):
            start -= 1
        at = min(n, end + ROOM)
        at = _REST.match(text, at).end() if _word(text[at - 1]) else at
        run = Run()
        for m in _TOKEN.finditer(text, start, at):
            a, b = m.span()
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if k < len(taken) and taken[k][0] < b:
                if run:
                    yield run
                run = Run()
            else:
                run.ends.extend((a, b))
        if run:
            yield run


@lru_cache(1 << 16)
def _feature(name: str) -> int:
    return crc32(name.encode()) % BUCKETS


_ONE, _NO_GROUPS = _feature("one"), _feature("g")
_DIGIT_COUNTS, _LETTER_COUNTS, _SIZES = ([_feature(f"{c}{k}") for k in range(most + 1)] for c, most in (("d", 24), ("l", 8), ("n", 48)))


def _shape(text: str) -> str:
    kinds = []
    for c in text:
        k = "9" if c.isdigit() else "a" if c.isalpha() else "_" if c.isspace() else c
        if not kinds or kinds[-1] != k or k not in "9a":
            kinds.append(k)
    return "".join(kinds)


def _parts(token: str) -> tuple[str, int, str, list[str]]:
    """Shape, number of digits, letters and digits, and lengths of the groups of ASCII digits."""
    compact = "".join(c for c in token if c.isalnum())
    return _shape(token), sum(c.isdigit() for c in compact), compact, [str(len(g)) for g in re.findall("[0-9]+", token)]


_short_parts = lru_cache(1 << 14)(_parts)


def features(text: str, tokens: Sequence[tuple[int, int]], i: int, ends: list[int]) -> Iterator[list[int]]:
    """Hashed features of the segments from token ``i`` to before each of ``ends``, and of their surroundings.

    What the segments of one start share is found once, and a longer segment goes on from a shorter one.
    """
    start = last = tokens[i][0]
    before = text[max(0, start - 24) : start]
    left = before[-1:] or " "
    left = "e" + ("x" if left.isalnum() else left if left in "\"'=:+-./@#_" else "s")
    words = [_feature(f"w{w}") for w in re.findall(r"[^\W\d_]+", before.lower())[-2:]]
    shape, digits, compact, groups, j = "", 0, "", [], i
    shaped = grouped = 0
    for to in ends:
        shape_known, groups_known = len(shape) >= 24, len(groups) >= 6
        while j < to:
            a, end = tokens[j]
            own = (_short_parts if end - a <= 64 else _parts)(text[a:end])
            shape += "_" + own[0] if a > last else own[0]
            digits, compact, groups = digits + own[1], compact + own[2], groups + own[3]
            j, last = j + 1, end
        letters, after = len(compact) - digits, text[end : end + 1]
        if not (shaped and shape_known):
            shaped = _feature(f"s{shape[:24]}")
        if not digits or letters:
            grouped = _NO_GROUPS
        elif not (grouped and groups_known):
            grouped = _feature("g" + "-".join(groups[:6]))
        found = [_ONE, _DIGIT_COUNTS[min(digits, 24)], _LETTER_COUNTS[min(letters, 8)], shaped, _SIZES[min(len(compact), 48)], *words]
        found += [_feature(left + ("x" if after.isalnum() else after if after in "\"'-/@:_" else "s")), grouped]
        names = []
        plain = compact.isascii()
        if digits and letters and plain and len(compact) >= 16 and len(compact) == end - start:
            mixture = sum(a.isdigit() != b.isdigit() for a, b in zip(compact, compact[1:], strict=False)) / len(compact)
            variety = len(set(compact)) / min(len(compact), 36)
            names += [f"m{int(8 * mixture)}", f"v{int(6 * variety)}", "h" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", compact) else "k"]
        if _long(text, start, end):
            lower = compact.lower()
            turns = sum(a.islower() and b.isupper() or a.isupper() and b.islower() for a, b in zip(compact, compact[1:], strict=False)) / len(compact)
            names += [f"t{int(8 * turns)}", f"o{int(10 * sum(c in 'aeiou' for c in lower) / len(lower))}"]
            names.append(f"q{min(max(map(len, re.split('[aeiouy]', lower))), 9)}")
        if not letters and 14 <= digits <= 19:
            names.append(f"luhn{luhn(_DIGITS.sub('', compact))}")
        if plain and 15 <= len(compact) <= 34 and re.match("[A-Za-z]{2}[0-9]{2}", compact):
            names.append(f"97{mod97(compact)}")
        if shape == "9.9.9.9":
            span = text[start:end]
            names.append(f"octets{_octets(span) if span.isascii() else False}")
        yield found + [_feature(x) for x in names] if names else found


def extents(text: str, tokens: Sequence[tuple[int, int]]) -> Iterator[tuple[int, list[int]]]:
    """First token and tokens behind the last of the segments worth scoring, by first token.

    They begin and end in a letter, digit, ``+`` or bracket, hold a digit, ``@`` or a
    word of ``LETTERS`` or more ASCII letters, and run over white space only between short groups that hold digits or brackets.
    """
    n = len(tokens)
    numeric, anchored = bytearray(n), bytearray(n)
    for k, (a, b) in enumerate(tokens):
        word = text[a:b]
        digit = any(c.isdigit() for c in word)
        numeric[k] = digit or word in ("(", ")", "+", "-")
        anchored[k] = digit or word == "@" or _long(text, a, b)
    for i in range(n):
        start, before = tokens[i]
        if not (text[start].isalnum() or text[start] in "+("):
            continue
        holds, ends = 0, []
        for j in range(i, min(i + LONGEST, n)):
            a, end = tokens[j]
            if a > before and not (a == before + 1 and text[before] == " " and numeric[j] and numeric[j - 1]) and j > i:
                break
            holds |= anchored[j]
            if holds and text[end - 1].isalnum():
                ends.append(j + 1)
            before = end
        if ends:
            yield i, ends


def candidates(text: str, tokens: Sequence[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """Segments (first token, token behind the last, features) worth scoring."""
    return [(i, j, f) for i, ends in extents(text, tokens) for j, f in zip(ends, features(text, tokens, i, ends), strict=True)]


class Field:
    """Weights: (features, kinds) for segments, (kinds + outside, kinds) for what stands before."""

    def __init__(self):
        self.weights = np.zeros((BUCKETS, len(KINDS)))
        self.follows = np.zeros((len(KINDS) + 1, len(KINDS)))

    def _lattice(self, n: int, segments: list) -> tuple[list[list], np.ndarray]:
        scores = [self.weights[f].sum(0) for _, _, f in segments]
        ending: list[list] = [[] for _ in range(n + 1)]
        for k, (i, j, _) in enumerate(segments):
            ending[j].append((i, k))
        return ending, np.array(scores).reshape(len(segments), len(KINDS))

    def _scored(self, starts: Iterable[tuple[int, list[int], list[list[int]]]]) -> Iterator[tuple[int, list[int], np.ndarray]]:
        """First token, tokens behind the last and scores of segments; ``SCORED`` or so are summed up at once."""
        held, flat, at = [], [], []

        def summed() -> Iterator[tuple[int, list[int], np.ndarray]]:
            scores = np.add.reduceat(self.weights[flat], at, axis=0)
            k = 0
            for i, ends in held:
                yield i, ends, scores[k : k + len(ends)]
                k += len(ends)

        for i, ends, listed in starts:
            held.append((i, ends))
            for f in listed:
                at.append(len(flat))
                flat += f
            if len(at) >= SCORED:
                yield from summed()
                held, flat, at = [], [], []
        if held:
            yield from summed()

    def _path(self, n: int, scored: Iterable[tuple[int, list[int], np.ndarray]], caution: float) -> list[tuple[int, int, int]]:
        ring = LONGEST + 1
        best = np.full((ring, OUTSIDE + 1), -np.inf)
        best[0, OUTSIDE] = 0
        length, before = np.zeros((n + 1, OUTSIDE + 1), np.int8), np.zeros((n + 1, OUTSIDE + 1), np.int8)
        kinds = np.arange(OUTSIDE)
        scored = iter(scored)
        following = next(scored, None)
        for i in range(n + 1):
            own = best[i % ring]
            if i:
                past = best[(i - 1) % ring]
                y = past.argmax()
                own[OUTSIDE], length[i, OUTSIDE], before[i, OUTSIDE] = past[y], 1, y
                past.fill(-np.inf)
            if following is not None and following[0] == i:
                ends, scores = np.array(following[1]), following[2]
                reach = own[:, None] + self.follows
                y = reach.argmax(0)
                value = reach[y, kinds] + scores - caution
                rows = ends % ring
                step, kind = np.nonzero(value > best[rows, :OUTSIDE])
                best[rows[step], kind] = value[step, kind]
                length[ends[step], kind], before[ends[step], kind] = ends[step] - i, y[kind]
                following = next(scored, None)
        found, j, y = [], n, int(best[n % ring].argmax())
        while j:
            i = j - int(length[j, y])
            if y != OUTSIDE:
                found.append((i, j, y))
            j, y = i, int(before[j, y])
        return found[::-1]

    def decode(self, n: int, segments: list, caution: float) -> list[tuple[int, int, int]]:
        """The best segmentation's (first token, end token, kind) of ``n`` tokens.

        ``caution`` is taken off every segment's score, in favour of leaving text alone.
        """
        by_start = ((i, list(own)) for i, own in groupby(segments, lambda s: s[0]))
        return self._path(n, self._scored((i, [s[1] for s in own], [s[2] for s in own]) for i, own in by_start), caution)

    def read(self, text: str, tokens: Sequence[tuple[int, int]], caution: float) -> list[tuple[int, int, int]]:
        """``decode`` of all candidates among ``tokens``, of which few are held at a time."""
        starts = ((i, ends, list(features(text, tokens, i, ends))) for i, ends in extents(text, tokens))
        return self._path(len(tokens), self._scored(starts), caution)

    def slopes(self, n: int, segments: list, truth: dict[tuple[int, int], int]) -> tuple[dict[int, np.ndarray], np.ndarray, float]:
        """Gradient of the log likelihood of ``truth``, by forward and backward sums."""
        ending, scores = self._lattice(n, segments)
        ahead = np.full((n + 1, OUTSIDE + 1), -np.inf)
        ahead[0, OUTSIDE] = 0
        summed = lambda x, axis=None: np.logaddexp.reduce(x, axis)
        for j in range(1, n + 1):
            ahead[j, OUTSIDE] = summed(ahead[j - 1])
            for i, k in ending[j]:
                ahead[j, :OUTSIDE] = np.logaddexp(ahead[j, :OUTSIDE], summed(ahead[i][:, None] + self.follows, 0) + scores[k])
        total = summed(ahead[n])
        behind = np.full((n + 1, OUTSIDE + 1), -np.inf)
        behind[n] = 0
        starting: list[list] = [[] for _ in range(n + 1)]
        for k, (i, j, _) in enumerate(segments):
            starting[i].append((j, k))
        by_feature: dict[int, np.ndarray] = {}
        follows = np.zeros_like(self.follows)
        for i in range(n - 1, -1, -1):
            behind[i] = behind[i + 1, OUTSIDE]
            for j, k in starting[i]:
                way = self.follows + scores[k] + behind[j, :OUTSIDE]
                behind[i] = np.logaddexp(behind[i], summed(way, 1))
                chance = np.exp(ahead[i][:, None] + way - total)
                follows -= chance
                delta = -chance.sum(0)
                kind = truth.get((i, j))
                if kind is not None:
                    delta[kind] += 1
                    before = next((y for (_, b), y in truth.items() if b == i), OUTSIDE)
                    follows[before, kind] += 1
                if np.abs(delta).max() > 1e-4:
                    for f in segments[k][2]:
                        by_feature[f] = by_feature.get(f, 0) + delta
        return by_feature, follows, float(total)


def _made(kind: str, r: random.Random) -> str:
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    if kind == "email":
        return f"{word()}{r.choice(['', '.', '_', '-'])}{r.choice([word(), digits(2)])}@{word()}{r.choice(['', digits(1)])}.{r.choice(['', word() + '.'])}{r.choice(['com', 'org', 'net', 'de', 'fr'])}"
    if kind == "ip":
        return ".".join(str(r.randint(0, 255)) for _ in range(4))
    if kind in ("card", "not card"):
        while True:
            code = r.choice("3456") + digits(r.choice([13, 15, 15, 15, 18]))
            if luhn(code) == (kind == "card"):
                break
        gap = r.choice(["", "", " ", "-"])
        return gap.join(code[k : k + 4] for k in range(0, len(code), 4))
    if kind == "phone":
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"+{r.randint(1, 99)} ({a}) {b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"+{r.randint(1, 99)}-{a}-{b}-{c}"])
    if kind == "secret":
        code = "0123456789abcdef" if r.random() < 0.6 else "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
        code = code[10:] if len(code) > 16 and r.random() < 0.4 else code
        return "".join(r.choice(code) for _ in range(r.choice([24, 32, 32, 36, 40, 40, 40, 64])))
    if kind == "long word":
        parts = []
        while sum(map(len, parts)) < LETTERS:
            parts.append("".join(r.choice(["b", "d", "str", "g", "l", "m", "nt", "r", "ch", "t", "s", "v", ""]) + r.choice(["a", "e", "i", "o", "u", "ie"]) for _ in range(r.randint(1, 4))) + r.choice(["", "n", "r", "st", "ng"]))
        return r.choice([str.lower, str.lower, str.capitalize, str.upper])("".join(parts)) if r.random() < 0.6 else "".join(x.capitalize() for x in parts)
    if kind in ("iban", "not iban"):
        head, tail = "".join(r.choice("DEFRITESGBNL") for _ in range(2)), digits(r.randint(14, 20))
        check = 98 - int("".join(str(int(c, 36)) for c in tail + head + "00")) % 97
        check = (check + (kind != "iban") * r.randint(1, 50)) % 100
        code = f"{head}{check:02}{tail}"
        return code if r.random() < 0.5 else " ".join(code[k : k + 4] for k in range(0, len(code), 4))
    if kind == "ssn":
        return f"{r.randint(100, 772)}-{r.randint(10, 99)}-{digits(4)}"
    return r.choice(
        [
            f"{r.randint(0, 9)}.{r.randint(0, 20)}", f"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 40)}", f"{r.randint(1900, 2040)}", f"{r.randint(1, 31)}.{r.randint(1, 12)}.{r.randint(1950, 2030)}",
            f"{r.randint(1950, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 31):02}", f"{r.randint(0, 23):02}:{r.randint(0, 59):02}", digits(r.randint(1, 12)), f"{digits(r.randint(1, 3))},{digits(3)}.{digits(2)}",
            f"{r.randint(256, 999)}.{digits(3)}.{r.randint(256, 999)}.{digits(2)}", f"{word()}{digits(2)}", f"@{word()}", f"{digits(3)}-{digits(3)}", f"{digits(4)}-{digits(4)}", f"{word()}-{digits(r.randint(1, 6))}",
            f"{word()}{digits(3)}{word()}", digits(r.randint(20, 40)), f"{digits(2)}/{digits(2)}", f"{digits(2)}%", f"#{digits(5)}", f"CC BY-NC {r.randint(1, 4)}.0",
        ]
    )


_LEADS = {
    "secret": ("token = \"{}\"", "key: {}", "api_key={}", "secret = '{}'", "password: {}", "{}", "Bearer {}"),
    "ssn": ("SSN {}", "social security number {}", "ssn: {}", "{}"),
    "iban": ("IBAN {}", "account {}", "{}"),
    "phone": ("call {}", "{}", "{}", "tel. {}"),
}


def training(stretches: list[str], n: int, seed: int = 3) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """``n`` texts with the (start, end, kind) of what was planted into them."""
    r, found = random.Random(seed), []
    carriers = [s for s in stretches if not _MARK.search(s)] or ["and then there is nothing more to say about it"]
    for _ in range(n):
        words = r.choice(carriers).split(" ")
        text, spans = " ".join(words[: len(words) // 2]), []
        for _ in range(r.choice([1, 1, 2])):
            kind = r.choice([*KINDS, "not card", "not iban", "long word", *["other"] * 6])
            value = _made(kind, r)
            lead = r.choice(_LEADS.get(kind, ("{}",)))
            at = len(text) + 1 + lead.index("{")
            if kind in KINDS:
                spans.append((at, at + len(value), KINDS.index(kind)))
            text += " " + lead.format(value) + r.choice(["", "", ",", ".", "!!", "###"]) + " " + r.choice(words)
        found.append((text + " " + " ".join(words[len(words) // 2 :]), spans))
    return found


def train(stretches: list[str], n: int = 1500, epochs: int = 4, rate: float = 0.5) -> Field:
    """A field fitted to planted data; the same for the same stretches."""
    field, lattices = Field(), []
    for text, spans in training(stretches, n):
        for tokens in zones(text, []):
            first, last = {a: k for k, (a, _) in enumerate(tokens)}, {b: k + 1 for k, (_, b) in enumerate(tokens)}
            truth = {(first[a], last[b]): y for a, b, y in spans if a in first and b in last}
            lattices.append((len(tokens), candidates(text, tokens), truth))
    grown, grown_follows = np.full_like(field.weights, 0.1), np.full_like(field.follows, 0.1)
    order = random.Random(5)
    for _ in range(epochs):
        order.shuffle(lattices)
        for n_tokens, segments, truth in lattices:
            if not segments:
                continue
            by_feature, follows, _ = field.slopes(n_tokens, segments, truth)
            for f, g in by_feature.items():
                grown[f] += g * g
                field.weights[f] += rate * g / np.sqrt(grown[f])
            grown_follows += follows * follows
            field.follows += rate * follows / np.sqrt(grown_follows)
    return field


def spans(text: str, field: Field, caution: float = 1.0) -> tuple[list, list]:
    """Base spans and the spans the field adds, each (start, end, number of the kind)."""
    base = base_spans(text)
    taken: list[tuple[int, int]] = []
    for a, b, _ in sorted(base):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    added = []
    for tokens in zones(text, taken):
        added += [(tokens[i][0], tokens[j - 1][1], y) for i, j, y in field.read(text, tokens, caution)]
    return base, added


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[y]}:{a}:{b}" for a, b, y in sorted(found, key=lambda s: (s[0], s[2], s[1])))


def redacted(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with every stretch of overlapping spans replaced by the kind it begins with."""
    out, at = [], 0
    for a, b, y in sorted(found):
        if a >= at:
            out += [text[at:a], f"[{KINDS[y].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _find(field: Field, caution: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text")
            data, offsets = utf8(texts)
            folded = data | 32
            letters = np.concatenate(([0], np.cumsum((folded >= 97) & (folded <= 122))))
            anchor = ((data >= 48) & (data <= 57)) | (data == 64)
            if len(data) >= LETTERS:
                anchor[LETTERS - 1 :] |= letters[LETTERS:] - letters[:-LETTERS] == LETTERS
            marks = np.concatenate(([0], np.cumsum(anchor)))
            worth = marks[offsets[1:]] > marks[offsets[:-1]]
            base, every, clean = [], [], []
            for row, look in enumerate(worth):
                if not look:
                    base.append([0, 0, 0, 0, ""])
                    every.append("")
                    clean.append(None)
                    continue
                text = texts[row].as_py()
                own, added = spans(text, field, caution)
                base.append([*(sum(y == k for _, _, y in own) for k in range(4)), listed(own)])
                every.append(listed(own + added))
                clean.append(redacted(text, own + added) if own or added else None)
            kept = batch.drop_columns(["_text"])
            columns = [pa.array([b[k] for b in base], pa.int64()) for k in range(4)]
            columns += [pa.array([b[4] for b in base], pa.string()), pa.array(every, pa.string()), pa.array(clean, pa.string())]
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], [*kept.schema.names, *(f"n_{k}" for k in BASE), "base", "spans", "redacted"])

    return run


def stretches(docs: DataFrame, text: str = "text", most: int = 400, length: int = 160) -> list[str]:
    """A stretch out of the middle of at most ``most`` texts, those first by hash."""
    value = F.col(f"`{text}`")
    rows = docs.select(F.xxhash64(value).alias("h"), F.substring(value, F.floor(F.length(value) / 3).cast("int") + 1, F.lit(length)).alias("s"))
    return [r["s"] for r in rows.filter("s <> ''").distinct().orderBy("h", "s").limit(most).collect()]


def find_personal(docs: DataFrame, field: Field, text: str = "text", caution: float = 1.0) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone, base, spans and redacted.

    ``base`` and ``spans`` list kind:start:end in code points; ``redacted`` is the text with
    its spans replaced, null where it has none. A null text is empty: no spans. Rows are judged
    one by one, so copies get equal results. Input columns of these names are replaced; an
    empty table gives an empty table.
    """
    names = [*(f"n_{k}" for k in BASE), "base", "spans", "redacted"]
    kept = [c for c in docs.columns if c not in names]
    inner = [f"c{k}" for k in range(len(kept))]
    columns = [F.col("`" + c.replace("`", "``") + "`").alias(i) for c, i in zip(kept, inner, strict=True)]
    rows = docs.select(*columns, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    shape = [f"{i} {rows.schema[i].dataType.simpleString()}" for i in inner]
    shape += [f"n_{k} long" for k in BASE] + ["base string", "spans string", "redacted string"]
    return rows.mapInArrow(_find(field, caution), ", ".join(shape)).toDF(*kept, *names)
