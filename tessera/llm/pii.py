"""Personal data replaced by surrogates that are keyed, of the same type, script and format, and distinct.

Detected: e-mail addresses, phone numbers, IPv4 and IPv6 addresses, payment card numbers with a valid check digit, US social
security numbers, IBANs, secrets (access keys, hexadecimal tokens, passwords in assignments) and persons: a given
name of the lexicon with a surname, names after a title, and names after words that introduce one ("my name is", "Name:",
"Signed by", ...), in the lexicon or not. Names that belong to such a mention are replaced in the rest of the document, too.

A surrogate is the image of the entity under a keyed permutation of all strings of its format. The permutation
is a shift by one, conjugated with a keyed Feistel permutation: one cycle through the format's
domain, so that an entity is never its own surrogate, two entities never share one and one entity has
the same in every document and every run. This holds without a dictionary and at any size. Formats:

* e-mail: letters stay letters of their script and case, digits digits; the top-level domain stays
  and a mail domain has one surrogate for all its addresses;
* phone: country code and punctuation stay; cards: the first digit, the grouping and the validity
  of the Luhn digit stay; IBAN: country, and the check digits become valid where they were valid;
* IPv4 and IPv6: octets or groups stay in range; secrets: letters, digits and case stay;
* persons: a given name becomes another of the same gender and script; surnames change letter by letter, vowels to
  vowels and consonants to consonants. Images that are given names are walked over, so that a
  surname's surrogate can't collide with one of a given name.

Addresses, cards and names count as one entity whatever their punctuation, and names and e-mail addresses
whatever their case; the case of a mention is kept.

The key comes from the session's setting `tessera.pii.key`; there is no default key. Where it is unset, a random one is made
and kept in the session: surrogates are then consistent within the session and can't be undone or joined by anyone
who has only this code. Set it to have the same surrogates in several runs.

Scale: one pass without a shuffle, in time linear in the length of a text. Defined cases: a null text stays null and has no entity; rows
that share a doc_id are handled each; a format with a single string (no letter or digit) stays; other
columns pass through replace_pii unchanged.
"""

from __future__ import annotations

import hashlib
import re
import secrets
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import map_arrow, replace_text, text_slices

KEY_SETTING = "tessera.pii.key"

GIVEN = {
    ("latin", "f"): "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa margaret sandra ashley emily donna michelle carol amanda melissa deborah stephanie rebecca laura helen sharon cynthia kathleen amy anna marie sophie camille juliette claire chloe isabelle monika ursula petra sabine ingrid heike katrin lucia carmen maria isabel pilar dolores elena".split(),
    ("latin", "m"): "james robert john michael david william richard joseph thomas charles christopher daniel matthew anthony mark donald steven paul andrew joshua kenneth kevin brian george timothy ronald edward jason jeffrey ryan jean pierre jacques michel philippe laurent olivier hans klaus wolfgang juergen dieter stefan matthias jose juan carlos miguel antonio javier pablo diego".split(),
    ("cyrillic", "f"): "анна мария елена ольга наталья татьяна ирина екатерина светлана юлия".split(),
    ("cyrillic", "m"): "александр дмитрий сергей андрей алексей иван михаил николай владимир павел".split(),
    ("greek", "f"): "μαρία ελένη αικατερίνη βασιλική σοφία αγγελική γεωργία δήμητρα".split(),
    ("greek", "m"): "γεώργιος ιωάννης κωνσταντίνος δημήτριος νικόλαος παναγιώτης βασίλειος χρήστος".split(),
}
_GIVEN_OF = {name: key for key, names in GIVEN.items() for name in names}

#: Letters that take each other's place: (script and kind) in lower case.
CLASSES = ["aeiou", "bcdfghjklmnpqrstvwxyz", "àâáäæçèéêëîïíñóôöùûúüÿœßìòåøãõ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουωάέήίόύώ", "βγδζθκλμνξπρστφχψς"]
_LETTER = {c: k for k, letters in enumerate(CLASSES) for c in letters}
LETTERS = "abcdefghijklmnopqrstuvwxyz"
HEX = "0123456789abcdef"

EMAIL = re.compile(r"(?<![\w.%+\-])[\w.%+\-]++(?<!\.)@(?:[\w\-]+\.)+[^\W\d_]{2,}")
NUMBER = re.compile(r"(?<![\w.@])(?:\+\d{1,3}[^\w\n]{0,6}\(?\d[\d \-./()*#$%&!]*\d|\(\d{2,4}\)[ \-.]{0,2}\d[\d \-.]{4,}\d|\d[\d.\-]*\d(?:[ ][\d.\-]*\d)*)(?![\w@])")
IPV4 = re.compile(r"(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}")
IPV6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")
CARD = re.compile(r"\d{13,19}|\d{4}(?:[ \-]\d{4}){3}|\d{4}[ \-]\d{6}[ \-]\d{5}")
SSN = re.compile(r"\d{3}-\d{2}-\d{4}")
LOCAL_PHONE = re.compile(r"\(?\d{2,4}\)?[ \-.]{1,2}\d{3,4}[ \-.]\d{3,4}(?:[ \-.]\d{2,4})?")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
SECRET = re.compile(r"(?<!\w)(?:(?:AKIA|ASIA|akia|asia)[A-Za-z0-9]{16}(?!\w)|(?:sk|pk|ghp|gho|xoxb|glpat)[-_][A-Za-z0-9_\-]{16,}|[0-9a-f]{32,128}(?!\w)|[0-9A-F]{32,128}(?!\w))")
ASSIGNED = re.compile(r"(?i)(?<![^\W_])(?:password|passwd|pwd|token|secret|api_?key)[\"']?[^\w\n\"']{0,6}[=:][^\w\n\"']{0,6}[\"']?([A-Za-z0-9_\-+/]{6,})")
TITLES = ("Mr", "Ms", "Mme", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor")
DIGIT = re.compile(r"\d")
SECRET_HEADS = ("AKIA", "ASIA", "akia", "asia", "sk-", "sk_", "pk-", "pk_", "ghp_", "gho_", "xoxb-", "glpat-")
_NAME = r"[A-ZÀ-ÞА-ЯΑ-ΩΆ-Ώ][\w'’\-]{1,60}+"
TITLED = re.compile(rf"(?<!\w)(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora|Mme)\.? ((?:{_NAME} )?{_NAME})")
PAIR = re.compile(rf"(?<![^\W_])([A-ZÀ-ÞА-ЯΑ-ΩΆ-Ώ][\w\-]{{1,60}}+)(?= ({_NAME}))")
#: Words that introduce the name of a person.
CUES = ("ame is ", "ame:", "igned", "incerely,", "egards,", "ttn", "ich heiße ", "m'appelle ", "me llamo ", "меня зовут ")
CUED = re.compile(rf"(?<!\w)(?:[Mm]y name is|[Nn]ame:|[Ss]igned(?: by|:)|[Ss]incerely,|[Rr]egards,|[Aa]ttn[.:]|[Ii]ch heiße|[Jj]e m'appelle|[Mm]e llamo|[Мм]еня зовут)\s{{1,3}}({_NAME}(?: {_NAME})?)")
WORD = re.compile(r"\w+")


def session_key(spark: SparkSession) -> bytes:
    """The key of the session, made where it has none."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return hashlib.blake2b(key.encode(), digest_size=32).digest()


class Permuter:
    """Keyed permutations of ranges of integers, without fixed points."""

    def __init__(self, key: bytes) -> None:
        self.key = key

    def _round(self, tweak: bytes, i: int, value: int, bits: int) -> int:
        size = (bits + 7) // 8
        digest = hashlib.blake2b(i.to_bytes(1, "big") + value.to_bytes(size, "big") + tweak, key=self.key, digest_size=min(64, max(8, size))).digest()
        return int.from_bytes(digest, "big") & ((1 << bits) - 1)

    def _feistel(self, tweak: bytes, n: int, x: int, back: bool) -> int:
        """A permutation of range(n), or its inverse: four rounds over an even number of bits, walked until in range."""
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            left, right = x >> half, x & mask
            if back:
                for i in (3, 2, 1, 0):
                    left, right = right ^ self._round(tweak, i, left, half), left
            else:
                for i in (0, 1, 2, 3):
                    left, right = right, left ^ self._round(tweak, i, right, half)
            x = left << half | right
            if x < n:
                return x

    def shift(self, tweak: str, n: int, x: int) -> int:
        """The successor of x on one keyed cycle through range(n)."""
        if n < 2:
            return x
        t = tweak.encode()
        return self._feistel(t, n, (self._feistel(t, n, x, True) + 1) % n, False)


def _spelled(p: Permuter, tweak: str, text: str, alphabets: list[str]) -> str:
    """The surrogate of a string whose characters come each from an alphabet."""
    n, x = 1, 0
    for c, a in zip(text, alphabets):
        x = x * len(a) + a.index(c)
        n *= len(a)
    x = p.shift(f"{tweak}|{'|'.join(alphabets)}", n, x)
    out = []
    for a in reversed(alphabets):
        x, k = divmod(x, len(a))
        out.append(a[k])
    return "".join(reversed(out))


def _luhn(payload: str) -> int:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _is_card(mention: str) -> bool:
    """Whether a number of 13 to 19 digits is that of a payment card: an issuer's first digit and a valid Luhn digit."""
    digits = "".join(c for c in mention if "0" <= c <= "9")
    return len(digits) > 12 and digits[0] in "23456" and _luhn(digits[:-1]) == int(digits[-1])


def _like(surrogate: str, mention: str) -> str:
    """The surrogate (lower case) in the case of the mention."""
    return "".join(s.upper() if m.isupper() and len(s.upper()) == 1 else s for s, m in zip(surrogate, mention))


def _fill(mention: str, new: str, of: str = "0123456789") -> str:
    """The mention with its characters of `of` replaced in order."""
    it = iter(new)
    return "".join(next(it) if c in of else c for c in mention)


class Surrogates:
    """The surrogate of every kind of entity, under one key."""

    def __init__(self, key: bytes) -> None:
        self.p = Permuter(key)
        self.replace = lru_cache(1 << 16)(self._replace)

    def _word(self, tweak: str, lower: str) -> str:
        """Letters to letters of their kind, digits to digits, in lower case."""
        if lower == "":
            return ""
        alphabets = [CLASSES[_LETTER[c]] if tweak == "surname" and c in _LETTER else LETTERS if "a" <= c <= "z" else CLASSES[_LETTER[c]] if c in _LETTER else "0123456789" if "0" <= c <= "9" else c for c in lower]
        return _spelled(self.p, tweak, lower, alphabets)

    def _email(self, x: str) -> str:
        local, _, domain = x.rpartition("@")
        labels = domain.split(".")
        host = ".".join(labels[:-1])
        low = local.lower()
        low = low if len(low) == len(local) else local
        new_host = self._word("domain", host.lower()) if len(host.lower()) == len(host) else host
        return f"{_like(self._word(f'email@{domain.lower()}', low), local)}@{_like(new_host, host)}.{labels[-1]}"

    def _phone(self, x: str) -> str:
        head = re.match(r"\+\d{1,3}(?=\D)", x)
        body = x[head.end() :] if head else x
        digits = [c for c in body if "0" <= c <= "9"]
        # the first digit of a number keeps its class
        alphabets = ["23456789" if digits[0] in "23456789" else "01", *["0123456789"] * (len(digits) - 1)]
        return (head[0] if head else "") + _fill(body, _spelled(self.p, f"phone{head[0] if head else ''}", "".join(digits), alphabets))

    def _card(self, x: str) -> str:
        digits = "".join(c for c in x if c.isdigit())
        body, off = digits[:-1], (int(digits[-1]) - _luhn(digits[:-1])) % 10
        body = body[0] + _spelled(self.p, f"card{off}{body[0]}", body[1:], ["0123456789"] * (len(body) - 1))
        return _fill(x, body + str((_luhn(body) + off) % 10))

    def _ipv4(self, x: str) -> str:
        n = 0
        for octet in x.split("."):
            n = n << 8 | int(octet)
        n = self.p.shift("ipv4", 1 << 32, n)
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))

    def _ipv6(self, x: str) -> str:
        n = self.p.shift("ipv6", 1 << 128, int("".join(g.rjust(4, "0") for g in x.split(":")), 16))
        return ":".join(f"{n >> s & 0xFFFF:x}" for s in range(112, -1, -16))

    def _iban(self, x: str) -> str:
        plain = x.replace(" ", "")
        body = _spelled(self.p, f"iban{plain[:2]}", plain[4:], ["0123456789" if c.isdigit() else LETTERS.upper() for c in plain[4:]])

        def check(b: str) -> int:
            return 98 - int("".join(str(int(c, 36)) for c in b + plain[:2] + "00")) % 97

        off = (int(plain[2:4]) - check(plain[4:])) % 100
        return _fill(x, plain[:2] + f"{(check(body) + off) % 100:02d}" + body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")

    def _secret(self, x: str) -> str:
        head = re.match(r"(?i)(?:akia|asia|sk[-_]|pk[-_]|ghp[-_]|gho[-_]|xoxb[-_]|glpat[-_])", x)
        start = head.end() if head else 0
        body = x[start:]
        if re.fullmatch(r"[0-9a-f]+", body) or re.fullmatch(r"[0-9A-F]+", body):
            sets = [HEX if body == body.lower() else HEX.upper()] * len(body)
        else:
            sets = ["0123456789" if c.isdigit() and c.isascii() else LETTERS if c in LETTERS else LETTERS.upper() if c in LETTERS.upper() else c for c in body]
        return x[:start] + _spelled(self.p, f"secret{x[:start]}", body, sets)

    def _given(self, x: str) -> str:
        key = _GIVEN_OF[x.lower()]
        names = GIVEN[key]
        # given names change length: the case is that of a name, or all capitals
        new = names[self.p.shift("given" + "".join(key), len(names), names.index(x.lower()))]
        return new.upper() if len(x) > 1 and x.isupper() else new.capitalize()

    def _surname(self, x: str) -> str:
        low = x.lower()
        if len(low) != len(x):
            low = x
        new = self._word("surname", low)
        while new in _GIVEN_OF and new != low:
            new = self._word("surname", new)
        return _like(new, x)

    def _replace(self, kind: str, mention: str) -> str:
        return getattr(self, f"_{kind}")(mention)


def _mentions(text: str, persons: dict[str, str]) -> list[tuple[int, int, str]]:
    """All mentions of the names, as written or in capitals: one pass over the words of the text."""
    by_word: dict[str, list[tuple[str, str]]] = {}
    for name, kind in persons.items():
        kind = "given" if name.lower() in _GIVEN_OF else kind
        for form in {name, name.upper()}:
            by_word.setdefault(WORD.match(form)[0], []).append((form, kind))
    out = []
    for m in WORD.finditer(text):
        for form, kind in by_word.get(m[0], ()):
            end = m.start() + len(form)
            if text.startswith(form, m.start()) and not WORD.match(text[end : end + 1]):
                out.append((m.start(), end, kind))
    return out


def find_entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, in order and without overlap; the first kind that fits wins."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(*m.span(), "email") for m in EMAIL.finditer(text)]
    if "=" in text or ":" in text:
        found += [(*m.span(1), "secret") for m in ASSIGNED.finditer(text)]
    digits = DIGIT.search(text) is not None
    if digits or any(x in text for x in SECRET_HEADS):
        found += [(*m.span(), "secret") for m in SECRET.finditer(text)]
    if digits and ":" in text:
        found += [(*m.span(), "ipv6") for m in IPV6.finditer(text)]
    if digits:
        found += [(*m.span(), "iban") for m in IBAN.finditer(text)]
    for m in NUMBER.finditer(text) if digits else ():
        a, run = m.start(), m[0]
        if run[0] == "+":
            # at most 15 digits make a phone number; what follows in the run is looked at by itself
            end, n = 0, 0
            for g in re.finditer(r"\d+", run):
                if n + len(g[0]) > 15 or (n >= 10 and len(g[0]) > 6):
                    break
                n += len(g[0])
                end = g.end()
            if n >= 8:
                found.append((a, a + end, "phone"))
                a, run = a + end, run[end:]
        for pattern, kind in ((CARD, "card"), (IPV4, "ipv4"), (SSN, "ssn"), (LOCAL_PHONE, "phone")):
            for x in pattern.finditer(run):
                before, after = run[x.start() - 1 : x.start()], run[x.end() : x.end() + 1]
                if kind == "card" and not _is_card(x[0]):
                    continue
                if not before.isdigit() and not after.isdigit() and not (kind != "phone" and (after in "-" and after or before in "-" and before)):
                    found.append((a + x.start(), a + x.end(), kind))
    persons: dict[str, str] = {}
    for m in PAIR.finditer(text):
        if m[1].lower() in _GIVEN_OF:
            found += [(*m.span(1), "given"), (*m.span(2), "surname")]
            persons |= {m[1]: "given", m[2]: "surname"}
    named = [*(TITLED.finditer(text) if any(x in text for x in TITLES) else ()), *(CUED.finditer(text) if any(x in text for x in CUES) else ())]
    for m in named:
        at = m.start(1)
        for part in m[1].split(" "):
            kind = "given" if part.lower() in _GIVEN_OF else "surname"
            found.append((at, at + len(part), kind))
            persons.setdefault(part, kind)
            at += len(part) + 1
    if persons:
        found += _mentions(text, persons)
    rank = {k: i for i, k in enumerate(("email", "iban", "secret", "ipv6", "card", "ipv4", "ssn", "phone", "given", "surname"))}
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(found, key=lambda e: (e[0], rank[e[2]], -e[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b, "given" if kind == "surname" and text[a:b].lower() in _GIVEN_OF else kind))
    return out


def _surrogate(s: Surrogates, kind: str, mention: str) -> str:
    if kind == "ssn":
        return _fill(mention, _spelled(s.p, "ssn", mention.replace("-", ""), ["0123456789"] * 9))
    return s.replace(kind, mention)


def surrogate_text(text: str | None, s: Surrogates) -> tuple[str | None, list[dict]]:
    """A text with surrogates, and its entities; their places are those in the new text."""
    if not text:
        return text, []
    parts, entities, at, size = [], [], 0, 0
    for a, b, kind in find_entities(text):
        new = _surrogate(s, kind, text[a:b])
        parts += [text[at:a], new]
        size += a - at
        entities.append({"kind": kind, "begin": size, "end": size + len(new), "surrogate": new})
        size += len(new)
        at = b
    return ("".join([*parts, text[at:]]) if entities else text), entities


def surrogates(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """(doc_id, text, n_entities, entities) of every row of docs: the new text and what it has in place of personal data.

    The key is that of the session where none is given.
    """
    key = key or session_key(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Surrogates(key)
        for batch in batches:
            for part in text_slices(batch):
                done = [surrogate_text(t, s) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([t for t, _ in done], pa.string()), pa.array([len(e) for _, e in done], pa.int32()), pa.array([e for _, e in done], kind)], names=["doc_id", "text", "n_entities", "entities"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, text string, n_entities int, entities array<struct<kind: string, begin: int, end: int, surrogate: string>>")


def replace_pii(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """The rows of docs with surrogates in their texts; columns as in docs. The key is that of the session where none is given."""
    key = key or session_key(docs.sparkSession)
    return replace_text(docs, lambda texts: [surrogate_text(t, s)[0] for s in [Surrogates(key)] for t in texts])
