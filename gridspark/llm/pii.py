"""Replaces personal data and secrets by surrogates of the same type and format.

Every surrogate is the value of a keyed permutation of all strings of the original's format, so equal
originals get equal surrogates in the whole corpus (coreference), different ones get different ones
(distinctness), and nothing but the key is shared by the tasks.  The permutation is a Feistel network with
cycle walking, P^-1(P(x) + s), which maps no value to itself.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import arrow_map, lean, tuned

#: Given names by script and gender, and titles that go before a name.
NAMES = {
    ("latin", "f"): "Alice Anna Barbara Camille Carmen Charlotte Claire Diana Elena Emily Emma Eva Grace Hannah Helen Isabel Jennifer Julia Karen Laura Linda Lucy Maria Marie Martha Mary Monica Nancy Nina Olivia Patricia Paula Rachel Rosa Ruth Sandra Sarah Sofia Susan Teresa".split(),
    ("latin", "m"): "Adam Albert Alexander Andrew Anthony Arthur Brian Carlos Charles Daniel David Edward Eric Frank George Hans Henry Ivan Jacob James Jean Johann John Jorge Joseph Juan Julian Klaus Louis Manuel Martin Michael Miguel Oscar Paul Pedro Peter Robert Thomas William".split(),
    ("cyrillic", "f"): "Анна Вера Галина Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей".split(),
    ("greek", "f"): "Άννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Αλέξανδρος Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Господин Госпожа Κύριος Κυρία".split()
#: Titles that go before a name in small letters, if they have a dot.
LOWER_TITLES = ("mr", "mrs", "dr")
_GIVEN = {name: names for names in NAMES.values() for name in names}
_TRIGGERS = frozenset([*_GIVEN, *TITLES, *LOWER_TITLES, *map(str.upper, _GIVEN)])
_ALPHABETS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789")
_OF = {c: a for a in _ALPHABETS for c in a}
_KEPT = ""
#: Symbols that one permutation takes at most; longer values are permuted in runs.
RUN = 64


@lru_cache(maxsize=1 << 12)
def _kin(block: int, kind: str) -> str:
    """The symbols of a block of 128 code points that are of one kind."""
    return "".join(c for c in map(chr, range(block << 7, (block + 1) << 7)) if _kind(c) == kind)


def _kind(c: str) -> str:
    """A letter's or digit's category, with a mark if one other symbol is its upper or lower case; none for other symbols."""
    kind = unicodedata.category(c)
    if kind[0] != "L" and kind != "Nd":
        return ""
    low, up = c.lower(), c.upper()
    return kind + ("+" if len(low) == 1 == len(up) and low != up and low.upper() == up and up.lower() == low else "")


def _alphabet(c: str) -> str:
    """The symbols that may stand for c: of the same script, case and category; none for what is neither letter nor digit."""
    if c < "\x80":
        return _OF.get(c, _KEPT)
    kind = _kind(c)
    return _kin(ord(c) >> 7, kind) if kind else _KEPT


def _round(key: bytes, tweak: bytes, i: int, x: int) -> int:
    return int.from_bytes(hashlib.blake2b(tweak + bytes([i]) + x.to_bytes((x.bit_length() + 7) // 8 or 1, "big"), key=key, digest_size=64).digest(), "big")


def _walk(key: bytes, tweak: bytes, x: int, n: int, forward: bool) -> int:
    """A keyed permutation of range(n): an eight-round Feistel network over the next even number of bits."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for i in range(8) if forward else range(7, -1, -1):
            if forward:
                a, b = b, a ^ (_wide(key, tweak, i, b, half) & mask)
            else:
                a, b = b ^ (_wide(key, tweak, i, a, half) & mask), a
        x = a << half | b
        if x < n:
            return x


def _wide(key: bytes, tweak: bytes, i: int, x: int, bits: int) -> int:
    out, have = _round(key, tweak, i, x), 512
    while have < bits:
        out = out << 512 | _round(key, tweak + have.to_bytes(4, "big"), i, x)
        have += 512
    return out


def permuted(key: bytes, tweak: str, x: int, n: int) -> int:
    """The image of x under a keyed permutation of range(n) that has no fixed point if n > 1."""
    if n < 2:
        return x
    t = hashlib.blake2b(tweak.encode() + b"|" + n.to_bytes((n.bit_length() + 7) // 8, "big"), digest_size=16).digest()
    step = 1 + _round(key, t, 255, 0) % (n - 1)
    return _walk(key, t, (_walk(key, t, x, n, True) + step) % n, n, False)


def _recode(key: bytes, tweak: str, symbols: list[str], alphabets: list[tuple[str, ...] | str]) -> list[str]:
    """The permutation applied to symbols[i] out of alphabets[i]; an empty alphabet keeps its symbol.

    Runs of RUN symbols are permuted one after the other, each by what was before it: different values stay
    different, and the time grows with their length.
    """
    out: list[str] = []
    before = hashlib.blake2b(tweak.encode(), digest_size=16)
    for at in range(0, len(symbols), RUN):
        run, of = symbols[at : at + RUN], alphabets[at : at + RUN]
        x, n, form = 0, 1, []
        for s, a in zip(run, of, strict=True):
            form.append(a[0] + a[-1] if a else s)
            if a:
                x, n = x * len(a) + a.index(s), n * len(a)
        x, new = permuted(key, tweak + "|" + "\x00".join(form) + ("|" + before.hexdigest() if at else ""), x, n), []
        for s, a in zip(reversed(run), reversed(of), strict=True):
            if a:
                x, r = divmod(x, len(a))
                s = a[r]
            new.append(s)
        out += reversed(new)
        before.update("\x00".join(run).encode())
    return out


def _letters(key: bytes, kind: str, text: str) -> str:
    """Every letter and digit by one of its own alphabet; hexadecimal strings stay so."""
    if re.fullmatch(r"[0-9a-f]{8,}", text):
        return "".join(_recode(key, kind, list(text), ["0123456789abcdef"] * len(text)))
    return "".join(_recode(key, kind, list(text), [_alphabet(c) for c in text]))


def _digits(key: bytes, kind: str, text: str, keep: int) -> str:
    """Digits but the first ``keep``; a digit from 2 to 9 that starts a group stays one (area codes and exchanges)."""
    out, seen = [], 0
    for i, c in enumerate(text):
        starts = i == 0 or not text[i - 1].isdigit()
        out.append(_KEPT if c not in "0123456789" or seen < keep else "23456789" if starts and c > "1" else "01" if starts else "0123456789")
        seen += c in "0123456789"
    return "".join(_recode(key, kind, list(text), out))


def _luhn(digits: str) -> int:
    return sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for i, d in enumerate(reversed(digits))) % 10


def _card(key: bytes, text: str) -> str:
    """The issuer's digit stays, the checksum's remainder too: valid numbers stay valid.

    The last digit is made from the others and the remainder, so the remainder is in its place when the permutation
    is chosen: numbers that differ in nothing else would otherwise be dealt by unrelated permutations.
    """
    places = [i for i, c in enumerate(text) if c.isdigit()]
    rest = _luhn("".join(text[i] for i in places))
    old = list(text)
    old[places[-1]] = str(rest)
    new = _recode(key, "card", old, ["0123456789" if i in set(places[1:-1]) else _KEPT for i in range(len(text))])
    new[places[-1]] = "0"
    new[places[-1]] = str((rest - _luhn("".join(new[i] for i in places))) % 10)
    return "".join(new)


_PUBLIC = tuple(str(i) for i in range(1, 224) if i not in (10, 127, 169, 172, 192))
_OCTETS = tuple(map(str, range(256)))


def _ip(key: bytes, text: str) -> str:
    """Public addresses stay public; the first number of other ones is kept."""
    parts = text.split(".")
    return ".".join(_recode(key, "ip", parts, [_PUBLIC if parts[0] in _PUBLIC else _KEPT, _OCTETS, _OCTETS, _OCTETS]))


def _email(key: bytes, text: str) -> str:
    local, _, domain = text.rpartition("@")
    reserved = re.search(r"(?:^|\.)example\.(?:com|net|org)$", domain, re.IGNORECASE)
    tail = reserved.start() if reserved else domain.rfind(".")
    whole = local + "@" + domain[:tail]
    return "".join(_recode(key, "email", list(whole), [_alphabet(c) for c in whole])) + domain[tail:]


def _ipv6(key: bytes, text: str) -> str:
    """Colons and the first group stay, so that the address is of the same sort."""
    first, colon, rest = text.partition(":")
    hexes = "0123456789abcdef" if text == text.lower() else "0123456789ABCDEF"
    return first + colon + "".join(_recode(key, "ipv6", list(rest), [(hexes if c in hexes else "0123456789abcdef") if c != ":" else _KEPT for c in rest]))


_MARKS = re.compile(r"sk-(?:proj-|ant-)?|gh[pousr]_|github_pat_|xox[abprs]-|AIza|glpat-|-----[^-]*-----\s*")


def _key(key: bytes, text: str) -> str:
    """What tells the key's issuer stays."""
    mark = _MARKS.match(text).end()
    return text[:mark] + _letters(key, "key", text[mark:])


def _iban_check(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban(key: bytes, text: str) -> str:
    tail = "".join(_recode(key, "iban" + text[:2], list(text[4:]), ["0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isalpha() else _KEPT for c in text[4:]]))
    bare = tail.replace(" ", "")
    return f"{text[:2]}{98 - _iban_check(text[:2] + '00' + bare):02d}{tail}"


def _given(key: bytes, text: str) -> str:
    """Another given name of the same gender and script, in the same case."""
    shout = text.isupper() and len(text) > 1
    name = text.capitalize() if shout else text
    names = _GIVEN[name]
    new = names[permuted(key, "given" + names[0], names.index(name), len(names))]
    return new.upper() if shout else new


def _family(key: bytes, text: str) -> str:
    """Letters of the same script; the same name in other case gets the same letters in that case."""
    cased = [_kind(c).endswith("+") and c.isupper() for c in text]
    new = _letters(key, "family", "".join(c.lower() if up else c for c, up in zip(text, cased, strict=True)))
    return "".join(c.upper() if up else c for c, up in zip(new, cased, strict=True))


_EMAIL = re.compile(r"(?<![\w.+%-])[\w](?:[\w.+%'&!#$*=?^~-]*[\w+%-])?@(?:[\w-]+\.)+[^\W\d_]{2,}")
_NUMBER = re.compile(r"(?<![\w.-])(?:(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d))|(?P<card>(?:\d{16}|\d{15}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d))|(?P<ssn>\d{3}-\d{2}-\d{4}(?![\d-]))|(?P<phone>(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5}(?!\d)|0\d{2,4}[ /-]\d{6,8}(?![\d-])))", re.ASCII)
_MAC = re.compile(r"(?<![\w:-])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![\w:-])|(?<![\w:-])(?:[0-9A-Fa-f]{2}-){5}[0-9A-Fa-f]{2}(?![\w:-])")
_SSN = re.compile(r"(?<![^\W_])(?i:ssn|social security(?: number)?)\W{0,3}(\d{9})(?!\d)", re.ASCII)
_AWS = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?<![^\W_])(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[\"']?\s*[=:]\s*(?:\"([^\"\n]{6,})\"|'([^'\n]{6,})'|([^\s\"',;]{6,}))", re.IGNORECASE)
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.ASCII)
_DIGITS = re.compile(r"\d\d|\d\.\d")
_WORD = re.compile(r"[^\W\d_]+")
_IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::|(?::[0-9A-Fa-f]{1,4}){1,6}|[0-9A-Fa-f]{1,4})(?![\w:])")
_KEY = re.compile(r"(?<![\w-])(?:sk-(?:proj-|ant-)?[A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|glpat-[A-Za-z0-9_-]{18,})(?![\w-])|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]+(?=-----END)", re.ASCII)
_MARK = re.compile(r"sk-|gh[pousr]_|github_pat_|xox[abprs]-|AIza|glpat-|PRIVATE KEY")
_TITLE = "|".join(TITLES)
#: Words that say that a name follows.
SAYS = ["my name is", "name is", "je m'appelle", "mon nom est", "ich heiße", "mein Name ist", "me llamo", "mi nombre es", "меня зовут", "με λένε", "名前は"]
_SAYS = re.compile(rf"(?i:(?<!\w)(?:{'|'.join(SAYS)})) +(?P<named>[^\W\d_]+(?:-[^\W\d_]+)?(?: [^\W\d_]+(?:-[^\W\d_]+)?){{0,2}})")
_SAID = re.compile("|".join(SAYS), re.IGNORECASE)
_NAME = re.compile(rf"(?<!\w)(?:(?:(?:{_TITLE})(?:\. *| +)|(?:{'|'.join(LOWER_TITLES)})\. *)(?P<titled>[^\W\d_]+(?:-[^\W\d_]+)?(?: +[^\W\d_]+)?)|(?P<plain>{'|'.join(sorted(_GIVEN, key=len, reverse=True))}) +(?P<family>[^\W\d_]+(?:-[^\W\d_]+)?))(?!\w)")


def _names(text: str, start: int, end: int, lower: bool) -> Iterator[tuple[int, int, str]]:
    """The words of a name from start to end.  A small word ends it; if lower, the first may be one, and the second after a given name."""
    for w in _WORD.finditer(text, start, end):
        if w[0] in _GIVEN or w[0].capitalize() in _GIVEN and w[0].isupper():
            yield *w.span(), "given"
        elif lower or not w[0][0].islower():
            yield *w.span(), "family"
        else:
            return
        lower = lower and w[0].capitalize() in _GIVEN


def entities(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and kind of everything personal in a text, by kind."""
    if "@" in text:
        for m in _EMAIL.finditer(text):
            yield *m.span(), "email"
    if _DIGITS.search(text):
        for m in _NUMBER.finditer(text):
            yield *m.span(), m.lastgroup
        for m in _SSN.finditer(text):
            yield *m.span(1), "ssn"
        for m in _IBAN.finditer(text):
            if _iban_check(m[0].replace(" ", "")) == 1:
                yield *m.span(), "iban"
    if "::" in text or text.count(":") > 6:
        for m in _IPV6.finditer(text):
            try:
                ipaddress.IPv6Address(m[0])
            except ValueError:
                continue
            if m[0].strip("0:") and any(c.isdigit() for c in m[0]):
                yield *m.span(), "ipv6"
    if text.count(":") > 4 or text.count("-") > 4:
        for m in _MAC.finditer(text):
            yield *m.span(), "mac"
    if _MARK.search(text):
        for m in _KEY.finditer(text):
            yield *m.span(), "key"
    if "AKIA" in text or "ASIA" in text:
        for m in _AWS.finditer(text):
            yield *m.span(), "aws_key"
    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            yield *m.span(m.lastindex), "secret"
    if not _TRIGGERS.isdisjoint(_WORD.findall(text)):
        for m in _NAME.finditer(text):
            if m["family"] and not m["family"][0].isupper():
                continue  # a word that is also a name
            if m["plain"]:
                yield *m.span("plain"), "given"
                yield from _names(text, *m.span("family"), False)
            else:
                yield from _names(text, *m.span("titled"), m[0][0].islower())
        for m in _WORD.finditer(text):
            a = m.start()  # a given name within a sentence
            if m[0] in _GIVEN and a > 1 and text[a - 1] == " " and (text[a - 2].islower() or text[a - 2] in ",;"):
                yield *m.span(), "given"
    if _SAID.search(text):
        for m in _SAYS.finditer(text):
            yield from _names(text, *m.span("named"), False)


def spans(text: str) -> list[tuple[int, int, str]]:
    """entities() in order of their place; of overlapping ones the first, the longest among those.

    A word that is part of a name is one wherever the text has it again with a capital, or its other mentions would
    tell what its surrogate stands for.
    """
    out = _apart(entities(text))
    names: dict[str, str] = {}
    for a, z, kind in out:
        if kind in ("given", "family") and z - a > 2 and not text[a].islower():
            names.setdefault(text[a:z], kind)
    if not names:
        return out
    taken = {a for a, _, _ in out}
    again = [(*m.span(), names[m[0]]) for m in _WORD.finditer(text) if m[0] in names and m.start() not in taken]
    return _apart([*out, *again], out) if again else out


def _apart(found: Iterable[tuple[int, int, str]], sure: Iterable[tuple[int, int, str]] = ()) -> list[tuple[int, int, str]]:
    """In order of their place, without those that overlap with one before them or with one of the sure ones."""
    sure, out, last = set(sure), [], 0
    ahead = sorted(a for a, _, _ in sure)
    for a, z, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if a >= last and ((a, z, kind) in sure or (k := bisect_left(ahead, a)) == len(ahead) or z <= ahead[k]):
            out.append((a, z, kind))
            last = z
    return out


_MAKERS: dict[str, Callable[[bytes, str], str]] = {
    "email": _email, "ip": _ip, "ipv6": _ipv6, "key": _key, "card": _card, "iban": _iban, "given": _given, "family": _family,
    "ssn": lambda k, t: "".join(_recode(k, "ssn", list(t), ["0123456789" if c.isdigit() else _KEPT for c in t])),
    "phone": lambda k, t: _digits(k, "phone", t, 0 if t[0] != "+" else 1 if t[1] == "1" else 2),
    "mac": lambda k, t: "".join(_recode(k, "mac", list(t), [next((x for x in ("0123456789", "abcdef", "ABCDEF") if c in x), _KEPT) for c in t])),
    "aws_key": lambda k, t: t[:4] + "".join(_recode(k, "aws", list(t[4:]), ["ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"] * (len(t) - 4))),
    "secret": lambda k, t: _letters(k, "secret", t),
}


@lru_cache(maxsize=1 << 14)
def _remembered(key: bytes, kind: str, value: str) -> str:
    return _MAKERS[kind](key, value)


def surrogate(key: bytes, kind: str, value: str) -> str:
    return _remembered(key, kind, value) if len(value) <= 4 * RUN else _MAKERS[kind](key, value)


def replace(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The new text, and kind, start, end (in the old text) and surrogate of each entity.

    Should two different values of a kind have become one in this text, the second is permuted once more.
    """
    found, out, last, of = [], [], 0, {}
    for a, z, kind in spans(text):
        old, new = text[a:z], surrogate(key, kind, text[a:z])
        for _ in range(8):
            if of.setdefault((kind, new), old) == old:
                break
            new = surrogate(key, kind, new)
        out += [text[last:a], new]
        last = z
        found.append((kind, a, z, new))
    return ("".join([*out, text[last:]]) if found else text), found


def anonymise(docs: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text with surrogates, n_entities, and entities (kind, start, end, surrogate, digest of the original).

    keep: columns that are handed through.  A null text stays null and has no entities, as an empty one;
    repeated rows are kept and come out alike; an empty table gives no rows.
    """
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()
    types = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batch: pa.RecordBatch) -> dict:
        texts, found = [], []
        for text in batch.column(1).to_pylist():
            new, spans_ = replace(text or "", secret)
            texts.append(None if text is None else new)
            found.append([{"kind": k, "start": a, "end": z, "surrogate": s, "original": hashlib.blake2b(text[a:z].encode(), key=secret, digest_size=16).hexdigest()} for k, a, z, s in spans_])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string()), ("original", pa.string())]))
        return {"doc_id": batch.column(0), "text": pa.array(texts, pa.string())} | {k: batch.column(i + 2) for i, k in enumerate(keep)} | {"n_entities": pa.array(map(len, found), pa.int32()), "entities": pa.array(found, kind)}

    schema = ", ".join(["doc_id long", "text string", *(f"`{k}` {types[k]}" for k in keep), "n_entities int", "entities array<struct<kind:string,start:int,end:int,surrogate:string,original:string>>"])
    return arrow_map(docs.select("doc_id", "text", *keep), run, schema)


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """docs with surrogates in text and n_chars, where there is one, counted anew; all other columns, whatever their names, as they are."""
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, names = list(batch.columns), batch.schema.names
            texts = [t if t is None else replace(t, secret)[0] for t in columns[at].to_pylist()]
            columns[at] = pa.array(texts, columns[at].type)
            if "n_chars" in names:
                place = names.index("n_chars")
                columns[place] = pa.array([None if t is None else len(t) for t in texts], columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    tuned(docs.sparkSession)
    return docs.mapInArrow(lean(run), docs.schema)


def collisions(anonymised: DataFrame) -> DataFrame:
    """Surrogates that stand for several originals, and originals with several surrogates, in the whole corpus: none."""
    each = anonymised.select(F.explode("entities").alias("e")).select("e.kind", "e.surrogate", "e.original").distinct()

    def several(by: str, other: str) -> DataFrame:
        n: Column = F.count(other)
        return each.groupBy("kind", by).agg(n.alias("n")).where("n > 1").select("kind", F.col(by).alias("value"), "n")

    return several("surrogate", "original").unionByName(several("original", "surrogate"))
