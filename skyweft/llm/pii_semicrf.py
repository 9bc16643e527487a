"""Personal data by a semi-Markov conditional random field over whole spans.

Exact patterns give the base spans (see BASE). The field adds spans that the patterns miss, such as
numbers written with other separators or addresses spelt out. Candidates are whole spans: every run
of up to MAX_GROUPS neighbouring digit groups, and words around a spelt ``at``. Features look at a
candidate as a whole (its groups, separators, digits, checksum, the word before it); it has the digits
that its kinds have, and does not begin or end inside of a longer number. A dynamic
programme over the candidates' boundaries, whose spans are bounded by MAX_GROUPS, finds the set of
non-overlapping typed spans of the highest joint score; text in no candidate scores zero, so
stretches without digits or a spelt ``at`` cannot change the optimum and are skipped. Dates, book
numbers, amounts, orders and the like are labelled as none of the kinds. Weights
maximise the conditional likelihood of labelled sentences, with expectations by the forward and
backward recursions over the same candidates. The sentences are made from a seed.

Base spans always stay. Of the field's spans those that meet no base span are added.

Defined cases: a null text counts as empty and has no spans. Spans are in code points, the end
exclusive. Repeated rows each get a row, a null doc_id stays null, an empty table gives no rows,
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweft.llm.batches import sliced

KINDS = ("email", "ip", "card", "phone")
#: Digit groups in one candidate; no entity of these kinds has more.
MAX_GROUPS = 6
MAX_GROUP_DIGITS = 19
#: Digits of a phone or card number, and groups of one digit in it (a country code, a last digit); an address has four groups.
LEAST_DIGITS, MOST_SINGLES = 7, 2
DOTS = (".", "[.]", "(.)")
#: So many groups with one separator throughout are a table of numbers, or a list of them; the field weighs that, no candidate is left out.
TABLE_GROUPS = 13
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_CUE = re.compile(r"[0-9@]|\bat\b|\[at\]|\(at\)", re.I)
_GROUP = re.compile(r"[0-9]+")
_JOINT = re.compile(r"[\x20.()\-/]{1,3}|\[\.\]|\(\.\)|\Z")
_SPELT = re.compile(r"([A-Za-z0-9._%+-]{1,64}(?:(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9._%+-]{1,64}){0,3})(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)([A-Za-z0-9-]{1,63}(?:(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{1,63}){1,4})")
_AT = re.compile(r"[\[(]at[\])]|\x20at\x20")
_REACH = 400
_HINT = re.compile(r"([A-Za-z]{2,12})[:#.\s(]{0,3}\Z")
_AFTER = re.compile(r"\s{0,2}([A-Za-z%$€£°]{1,12})")
_HINTS = {"phone": "phone tel telephone telefon call fax mobile mobil cell whatsapp dial ring", "card": "card visa mastercard amex credit debit pan", "ip": "ip host server address addr ping", "email": "email mail contact write",
          "number": "isbn issn ean order invoice number no nr id page pages section chapter version release code zip article case room build serial item ref since from in year until between lot model part sku account ticket case"}
_HINT_OF = {w: k for k, ws in _HINTS.items() for w in ws.split()}
#: Words that a count or a measure is followed by, and verbs and nouns that stand before a plain ``at``.
_UNITS = frozenset("eur usd euro euros dollars pounds km kg m cm mm percent people years items pages rows copies % $ € £ ° am pm h s ms mb gb kb units".split())
_PLAIN = frozenset("meet look arrive stay live work be is was are were start begin end stop sit stand eat aim laugh point shot sold open closed met arrived looked stayed lived worked available held based located people team again".split())
_TLDS = frozenset("com org net edu gov io de fr es it uk nl eu info biz co us ch at jp".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches of local part, @ and dotted domain, found from each @ in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end(), "email"
            done = m.end()
        elif start < at:
            done = max(done, at)  # no later match begins in this run
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The exact patterns' spans, by start, then kind as listed."""
    if not _CUE.search(text):
        return []
    out = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int, tuple[str, ...], tuple]]:
    """(start, end, kinds, what its features follow from) of all candidate spans."""
    out = []
    groups = [m.span() for m in _GROUP.finditer(text)]
    unit_after: dict[int, bool] = {}
    gaps = [None] + [gap if len(gap := text[e:b]) <= 3 and _JOINT.fullmatch(gap) else None for (_, e), (b, _) in zip(groups, groups[1:], strict=False)]
    table = _tables(text, groups)
    for i, (a, _) in enumerate(groups):
        if a and (text[a - 1].isalnum() or text[a - 1] in "_@" or text[a - 1] in "-./" and text[a - 2 : a - 1].isdigit()):
            continue  # within a word or a longer number
        start = a - 1 if a and text[a - 1] == "(" else a
        if start and text[start - 1] == "+":
            start -= 1
        sizes, joints, total, singles, before = [], [], 0, 0, None
        for j in range(i, min(i + MAX_GROUPS, len(groups))):
            b, e = groups[j]
            if j > i:
                if gaps[j] is None:
                    break
                joints.append(gaps[j])
            sizes.append(e - b)
            total += e - b
            singles += e - b == 1
            if total > MAX_GROUP_DIGITS or singles > MOST_SINGLES and (len(sizes) > 4 or joints[0] not in DOTS):
                break
            dotted = len(sizes) == 4 and joints[0] in DOTS and joints[0] == joints[1] == joints[2]
            if not dotted and (total < LEAST_DIGITS or singles > MOST_SINGLES):
                continue
            after = text[e : e + 1]
            if after and (after.isalnum() or after in "_@" or after in "-./" and text[e + 1 : e + 2].isdigit()):
                continue
            if before is None:
                before = (_hint(text, start), text[max(0, start - 2) : start].strip()[-1:] in ("$", "€", "£", "#"))
            if e not in unit_after:
                m = _AFTER.match(text, e)
                unit_after[e] = bool(m) and m[1].lower() in _UNITS
            out.append((start, e, ("ip", "card", "phone") if dotted else ("card", "phone"), _digit_key(text, start, a, groups[i : j + 1], sizes, joints, before, unit_after[e], bool(table[i]))))
    for m in _spelt(text):
        spelt = m[0].lower()
        last = re.split(r"[^A-Za-z0-9]+", m[0])[-1]
        f = ["spelt", f"known={last in _TLDS}", f"plain={m[1].lower() in _PLAIN}", f"capital={last[:1].isupper()}", f"how={'[' in spelt or '(' in spelt}&{' dot ' in spelt or '[dot]' in spelt or '(dot)' in spelt}&{last in _TLDS}", f"bracket={'[' in spelt or '(' in spelt}", f"dot={' dot ' in spelt or '[dot]' in spelt or '(dot)' in spelt}", f"parts={min(4, m[2].count('.') + spelt.count('dot'))}", f"tld={len(re.split(r'[^a-z0-9]+', spelt)[-1]) in (2, 3)}", f"mark={any(c in m[1] for c in '._0123456789')}"]
        out.append((m.start(), m.end(), ("email",), (*f, *_before(_hint(text, m.start())))))
    return sorted(out, key=lambda c: (c[1], c[0]))


def _spelt(text: str):
    """Matches of a spelt address, looked for around each spelt ``at`` as far as one can reach."""
    lo = hi = 0
    for m in _AT.finditer(text):
        if m.start() - _REACH > hi:
            yield from _SPELT.finditer(text, lo, hi)
            lo = m.start() - _REACH
        hi = m.end() + _REACH
    yield from _SPELT.finditer(text, lo, hi)


def _tables(text: str, groups: list[tuple[int, int]]) -> bytearray:
    """Which groups stand in a table of numbers."""
    out, first = bytearray(len(groups)), 0
    for k in range(1, len(groups) + 1):
        gap = text[groups[k - 1][1] : groups[k][0]] if k < len(groups) and groups[k][0] - groups[k - 1][1] < 4 else None
        if k == first + 1:
            joint = gap
        if gap is None or gap != joint:
            if k - first >= TABLE_GROUPS:
                out[first:k] = b"\1" * (k - first)
            first = k if gap is None else k - 1
            joint = gap
    return out


def _hint(text: str, start: int) -> str | None:
    m = _HINT.search(text, max(0, start - 20), start)
    return _HINT_OF.get(m[1].lower()) if m else None


def _before(hint: str | None) -> list[str]:
    return [f"hint={hint}", f"hinted={hint is not None}"]


def _digit_key(text, start, a, spans, sizes, joints, before, unit, table) -> tuple:
    digits = "".join([text[b:e] for b, e in spans])
    parts_ok = len(sizes) == 4 and all(s <= 3 and int(text[b:e]) <= 255 for s, (b, e) in zip(sizes, spans, strict=True))
    joint = "none" if not joints else joints[0] if len(set(joints)) == 1 else "mixed"
    n = len(digits)
    first = "+" if text[start] == "+" else "00" if digits.startswith("00") else "0" if digits[0] == "0" else "978" if n == 13 and digits[:3] in ("978", "979") else "year" if sizes[0] == 4 and digits[:2] in ("19", "20") else "x"
    return first, tuple(sizes), before[0], n, unit or before[1], joint, parts_ok, n >= 12 and luhn(digits), "(" in text[start:a] or any(")" in j for j in joints), table


def _features(key: tuple) -> list[str]:
    if not isinstance(key[1], tuple):  # those of a spelt address as they are
        return list(key)
    first, sizes, hint, n, unit, joint, parts_ok, check, bracket, table = key
    near = _before(hint)
    return [
        f"first={first}",
        f"first={first}&groups={len(sizes)}&{near[0]}",
        f"first={first}&n={n}",
        f"unit={unit}",
        f"over={len(sizes) == 4 and joint in ('.', '[.]', '(.)') and not parts_ok}",
        f"n={n if n < 20 else 20}",
        f"luhn={check}",
        f"card={12 < n < 20 and check}",
        f"shape={'-'.join(map(str, sizes)) if len(sizes) < 6 else 'long'}",
        f"joint={joint}",
        f"plus={first == '+'}",
        f"bracket={bracket}",
        f"octets={parts_ok and joint not in ('none', 'mixed') and '.' in joint}",
        f"n3={n // 3}&groups={len(sizes)}",
        *near,
        *([f"table&first={first}", f"table&first={first}&groups={len(sizes)}", f"table&card={12 < n < 20 and check}&{'-'.join(map(str, sizes))}"] if table else []),
    ]


class Weights(dict):
    """Weights by (kind, feature) that remember the scores of what was seen, up to MOST entries."""

    MOST = 100_000

    def __init__(self, *args):
        super().__init__(*args)
        self.seen: dict = {}

    def scores(self, kinds: tuple[str, ...], key: tuple) -> list[float]:
        found = self.seen.get((kinds, key))
        if found is None:
            if len(self.seen) >= self.MOST:
                self.seen.clear()
            found = self.seen[kinds, key] = _scored(self, kinds, _features(key))
        return found


def _scored(weights, kinds: tuple[str, ...], feats: list[str]) -> list[float]:
    get = weights.get
    return [get((k, ""), 0.0) + sum(get((k, f), 0.0) for f in feats) for k in kinds]


def _segments(text: str, weights: dict[tuple[str, str], float]):
    """(start, end, kind, score, what its features follow from) of all candidates and kinds."""
    out = []
    remembered = isinstance(weights, Weights)
    for start, end, kinds, key in candidates(text):
        scores = weights.scores(kinds, key) if remembered else _scored(weights, kinds, _features(key))
        out += [(start, end, k, x, key) for k, x in zip(kinds, scores, strict=True)]
    return out


def decode(text: str, weights: dict[tuple[str, str], float]) -> list[tuple[int, int, str]]:
    """The best set of non-overlapping typed spans; ties keep fewer spans."""
    segs = [s for s in _segments(text, weights) if s[3] > 0]  # a span below zero only lowers the sum
    if not segs:
        return []
    ends = sorted({s[1] for s in segs})
    at = {e: i + 1 for i, e in enumerate(ends)}
    best, back = [0.0] * (len(ends) + 1), [None] * (len(ends) + 1)
    by_end: dict[int, list] = {}
    for s in segs:
        by_end.setdefault(s[1], []).append(s)
    from bisect import bisect_right

    for i, e in enumerate(ends, 1):
        best[i], back[i] = best[i - 1], None
        for start, _, kind, score, _ in by_end[e]:
            j = bisect_right(ends, start)
            if best[j] + score > best[i]:
                best[i], back[i] = best[j] + score, (j, start, e, kind)
    out, i = [], at[ends[-1]]
    while i:
        if back[i] is None:
            i -= 1
        else:
            j, start, e, kind = back[i]
            out.append((start, e, kind))
            i = j
    return out[::-1]


def labelled_sentences(n: int = 900, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Made-up sentences with the spans of their entities, and with numbers that are none."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(2, 9)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card(sizes):
        body = num(sum(sizes) - 1)
        digits = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        out, i = [], 0
        for s in sizes:
            out.append(digits[i : i + s])
            i += s
        return r.choice([" ", "-", ".", "-"]).join(out)

    def phone():
        a, b, c, area = num(3), num(3), num(4), "0" + r.choice("12345789") + num(r.randint(1, 3))
        return r.choice(
            [
                f"({a}) {b}-{c}", f"+{r.randint(1, 99)} ({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"{a}.{b}.{c}",
                f"{area} {num(r.randint(5, 8))}", f"{area}/{num(r.randint(5, 8))}", f"{area}-{num(r.randint(5, 8))}", f"({area}) {num(r.randint(5, 8))}", f"{area} {a} {c}", f"{area}/{a} {c}",
                f"0{r.randint(1, 9)} {num(2)} {num(2)} {num(2)} {num(2)}", f"00{r.randint(1, 99)} {a} {num(6)}", f"0{num(9)}", f"0{num(10)}", f"020 {num(4)} {num(4)}",
            ]
        )

    def ip():
        p = [str(r.randint(1, 255)) for _ in range(4)]
        return r.choice([".", ".", "[.]", "(.)"]).join(p)

    def mail():
        a, d = r.choice([("[at]", "[dot]"), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)")])
        return f"{word()}{r.choice(['', '.' + word(), num(2), d + word()])}{a}{word()}{d}{r.choice(['com', 'org', 'net', 'de', 'fr'])}"

    entity = {"card": lambda: card(r.choice([(4, 4, 4, 4), (16,), (4, 6, 5), (4, 4, 4, 4), (13,), (4, 4, 4, 4)])), "phone": phone, "ip": ip, "email": mail}
    day, month, year = (lambda: f"{r.randint(1, 28):02d}"), (lambda: f"{r.randint(1, 12):02d}"), (lambda: str(r.randint(1950, 2030)))
    octets = lambda: ".".join(str(x) for x in r.sample([r.randint(0, 255), r.randint(0, 255), r.randint(0, 255), r.randint(256, 999)], 4))
    other = [
        lambda: f"{year()}-{month()}-{day()}",
        lambda: f"{day()}.{month()}.{year()}",
        lambda: f"{month()}/{day()}/{year()}",
        lambda: f"{r.choice(['isbn ', 'ISBN ', 'ISBN: ', ''])}{r.choice(['978', '979'])}-{r.randint(0, 9)}-{num(2)}-{num(6)}-{r.randint(0, 9)}",
        lambda: f"{r.choice(['issn ', 'ISSN '])}{num(4)}-{num(4)}",
        octets,
        lambda: f"{r.choice(['order ', 'invoice ', 'id ', 'no. ', 'ref '])}{num(r.randint(3, 6))}{r.choice(['-', ' ', '/'])}{num(r.randint(3, 6))}",
        lambda: f"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}",
        lambda: f"version {r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(256, 9999)}",
        lambda: r.choice("123456789") + num(r.randint(3, 17)),
        lambda: f"{r.randint(1000, 9999)} {num(4)} {num(4)} {num(3)}1",
        lambda: f"{r.randint(1, 999)},{num(3)}.{num(2)}",
        lambda: f"{r.randint(1, 999)} {num(3)} {num(3)} {r.choice(['people', 'euros', 'km', 'rows', 'copies'])}",
        lambda: f"{r.choice('$€£')}{r.randint(1, 999)}.{num(2)}",
        lambda: f"{r.randint(10, 99)} {num(2)} {num(2)}",
        lambda: f"{r.randint(100, 999)}-{num(r.randint(1, 2))}-{num(5)}",
        lambda: f"{r.randint(10000, 99999)}-{num(4)}",
        lambda: f"{year()}-{year()}",
        lambda: f"{r.choice(['pages ', 'section ', 'chapter '])}{r.randint(100, 999)}-{r.randint(1000, 9999)}",
        lambda: f"{r.randint(1, 90)}.{num(4)} {r.randint(1, 90)}.{num(4)}",
        lambda: f"{word()} at {word()}.",
        lambda: f"{word()} at {word()} and {word()}",
        lambda: f"{r.choice(sorted(_PLAIN))} at {word()}.{word().capitalize()}",
        lambda: f"{r.choice(sorted(_PLAIN))} at {word()}.{r.choice(['com', 'org', 'net', 'de'])}",
        lambda: f"{word()} at {word()}.{word()}",
        lambda: f"{num(4)} - {num(4)}",
        lambda: f"{r.choice(['ticket ', 'order ', 'id ', 'case '])}0{num(r.randint(6, 9))}",
    ]
    out = []
    for _ in range(n):
        text, spans = word(), []
        for _ in range(r.randint(1, 4)):
            text += " " + " ".join(word() for _ in range(r.randint(1, 5))) + " "
            if r.random() < 0.5:
                kind = r.choice(KINDS)
                if r.random() < 0.5:
                    text += r.choice(_HINTS[kind].split()) + r.choice([" ", ": "])
                value = entity[kind]()
                spans.append((len(text), len(text) + len(value), kind))
                text += value
            else:
                text += r.choice(other)()
        out.append((text + " " + word() + ".", spans))
    return out


def number_lists(n: int = 300, seed: int = 12) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Made-up runs of TABLE_GROUPS and more digit groups with one separator: tables of numbers, and lists of phone and card numbers."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    figure = lambda k: r.choice("123456789") + num(k - 1)

    def card(joint):
        body = num(15)
        digits = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        return joint.join(digits[i : i + 4] for i in (0, 4, 8, 12))

    def phone(joint):
        a = "0" + r.choice("12345789") + num(r.randint(1, 3))
        return joint.join((a, num(r.randint(5, 8))) if r.random() < 0.7 else (a, num(3), num(4)))

    out = []
    for _ in range(n):
        joint, kind = r.choice([" ", " ", " ", ".", "/", "-"]), r.choice(["phone", "card", "table", "table", "table"])
        text, spans = r.choice(["", "numbers ", "row "]), []
        if kind == "table":
            most, same = r.randint(1, 8), r.random() < 0.4
            text += joint.join(figure(most if same else r.randint(1, most)) if r.random() < 0.97 else "0" for _ in range(r.randint(TABLE_GROUPS, 40)))
        else:
            joint = " "
            for k in range(r.randint(TABLE_GROUPS // (2 if kind == "phone" else 4) + 1, 12)):
                value = phone(joint) if kind == "phone" else card(joint)
                text += joint * (k > 0)
                spans.append((len(text), len(text) + len(value), kind))
                text += value
        out.append((text + r.choice(["", "\n", " end."]), spans))
    return out


def train(sentences, rounds: int = 4, rate: float = 0.3, decay: float = 1e-3) -> dict[tuple[str, str], float]:
    """Weights by stochastic gradient ascent on the conditional likelihood."""
    w: dict[tuple[str, str], float] = {}
    step: dict[tuple[str, str], float] = {}
    for _ in range(rounds):
        for text, spans in sentences:
            segs, gold = _segments(text, w), set(spans)
            if not segs:
                continue
            points = sorted({p for s in segs for p in s[:2]})
            at = {p: i for i, p in enumerate(points)}
            n = len(points)
            ahead, behind = [0.0] * n, [0.0] * n
            into: dict[int, list] = {}
            out: dict[int, list] = {}
            for s in segs:
                into.setdefault(at[s[1]], []).append((at[s[0]], s[3]))
                out.setdefault(at[s[0]], []).append((at[s[1]], s[3]))
            for i in range(1, n):
                ahead[i] = _log_sum([ahead[i - 1], *(ahead[j] + x for j, x in into.get(i, ()))])
            for i in range(n - 2, -1, -1):
                behind[i] = _log_sum([behind[i + 1], *(behind[j] + x for j, x in out.get(i, ()))])
            change: dict[tuple[str, str], float] = {}
            for start, end, kind, score, seen in segs:
                p = math.exp(min(0.0, ahead[at[start]] + score + behind[at[end]] - ahead[-1]))
                g = ((start, end, kind) in gold) - p
                if abs(g) > 1e-4:
                    for f in ("", *_features(seen)):
                        change[kind, f] = change.get((kind, f), 0.0) + g
            for key, g in change.items():
                g -= decay * w.get(key, 0.0)
                step[key] = step.get(key, 1e-6) + g * g
                w[key] = w.get(key, 0.0) + rate * g / math.sqrt(step[key])
    return w


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


@cache
def default_weights() -> tuple[tuple[tuple[str, str], float], ...]:
    return tuple(sorted(train(labelled_sentences() + number_lists()).items()))


def find_spans(text: str | None, weights: dict[tuple[str, str], float]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of a text, each by start, then kind as listed."""
    if not text or not _CUE.search(text):
        return [], []
    base = base_spans(text)
    taken = sorted((a, b) for a, b, _ in base)
    extra, i = [], 0
    for a, b, k in decode(text, weights):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if not any(x < b and a < y for x, y in taken[max(0, i - 4) : i + 4]):
            extra.append((a, b, k))
    return base, sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2])))


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span put as its kind's mark; overlapping spans become one, of the first kind."""
    out, done = [], 0
    for a, b, k in spans:
        if a >= done:
            out += [text[done:a], MARKS[k]]
        done = max(done, b)
    return "".join([*out, text[done:]])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` for every row of ``docs``."""
    weights = Weights(default_weights())

    def run(batches):
        for batch in sliced(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, spans = find_spans(text, weights)
                kinds = [k for _, _, k in base]
                rows.append((doc, *(kinds.count(k) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
            types = [pa.int64()] * 5 + [pa.string()] * 2
            cols = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with all spans of ``text_col`` put as marks; null texts stay null."""
    weights = Weights(default_weights())

    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in sliced(batches):
            texts = [t if t is None else masked(t, find_spans(t, weights)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
