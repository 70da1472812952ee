"""Surrogates for personal data: keyed, type-consistent and one to one.

Detected entities are replaced by values of their own kind. Digits, letters and hex digits are
permuted by a keyed Feistel cipher over all strings of the same shape, names by a keyed permutation
of the given names of the same gender and script and a cipher over surnames of the same letters.
Each map is a bijection of its shape: an entity has the same surrogate wherever it occurs and no two
share one, without a table of all entities. Every map is one cycle, so nothing is its own surrogate.
`collisions` checks over a whole corpus that no two entities share a surrogate; `checked` raises if two do.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache
from ipaddress import IPv6Address
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import cut

# Given names by script and gender.
GIVEN = {
    ("latin", "f"): "Alice Amelia Anna Barbara Camille Carmen Caroline Catherine Charlotte Chiara Christine Claudia Daniela Elena Elisabeth Emily Emma Eva Fatima Francesca Gabriela Hannah Helena Ingrid Isabella Jennifer Jessica Johanna Julia Katharina Laura Linda Lucia Margaret Maria Martina Mary Michelle Monika Nicole Olivia Patricia Petra Rachel Sabine Sandra Sarah Silvia Sofia Sophie Stephanie Susan Teresa Ursula Valentina Victoria".split(),
    ("latin", "m"): "Adam Alexander Andreas Andrew Antonio Benjamin Bernd Carlos Charles Christian Daniel David Diego Dieter Edward Emil Fernando Francisco Frank François Friedrich George Hans Harry Henry Jack Jakob James Javier Jean Jens John Jorge Joseph José Juan Jürgen Karl Klaus Louis Luca Luis Manuel Marco Martin Matthew Michael Miguel Nicolas Oliver Pablo Patrick Paul Pedro Peter Philip Pierre Ricardo Richard Robert Stefan Thomas William Wolfgang".split(),
    ("cyrillic", "f"): "Александра Анастасия Анна Вера Виктория Галина Дарья Екатерина Елена Ирина Ксения Людмила Мария Марина Надежда Наталья Нина Ольга Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Василий Виктор Владимир Дмитрий Евгений Иван Игорь Константин Максим Михаил Николай Олег Павел Пётр Роман Сергей Юрий".split(),
    ("greek", "f"): "Αικατερίνη Αννα Βασιλική Γεωργία Δήμητρα Ειρήνη Ελένη Ιωάννα Κωνσταντίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Αθανάσιος Βασίλειος Γεώργιος Δημήτριος Ευάγγελος Ιωάννης Κωνσταντίνος Νικόλαος Παναγιώτης Χρήστος".split(),
}
# Titles that go before a name, by gender ("" for either).
TITLES = {"f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra".split(), "m": "Mr Herr Monsieur Señor Sr".split(), "": "Dr Prof".split()}
# Letters of surnames by script, vowels and consonants apart so that surrogates can be spoken.
VOWELS = {"latin": "aeiou", "accented": "áàâäãåéèêëíìîïóòôöõúùûüøœæ", "cyrillic": "аеиоуыэюяё", "greek": "αεηιουωάέήίόύώ"}
CONSONANTS = {"latin": "bcdfghjklmnpqrstvwxyz", "accented": "çñßšžčćłśźń", "cyrillic": "бвгджзйклмнпрстфхцчшщьъ", "greek": "βγδζθκλμνξπρστφχψς"}

ROUNDS = 8


class Cipher:
    """Keyed permutations of [0, n) and of strings of a shape; tweak keeps kinds apart."""

    def __init__(self, key: bytes):
        self.key = key

    def _draw(self, tweak: str, n: int, i: int, x: int) -> int:
        digest = hmac.digest(self.key, f"{tweak}|{n}|{i}|{x}".encode(), "sha256")
        if n.bit_length() > 224:  # long shapes need more bits
            digest = hashlib.shake_256(digest).digest(n.bit_length() // 8 + 16)
        return int.from_bytes(digest, "big")

    def _feistel(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        """Feistel over a * b >= n with cycle walking: a bijection of [0, n), or its inverse."""
        a = isqrt(n - 1) + 1
        b = (n + a - 1) // a
        while True:
            left, right = divmod(x, b)
            for i in range(ROUNDS - 2, -1, -2) if back else range(0, ROUNDS, 2):
                if back:
                    right = (right - self._draw(tweak, n, i + 1, left)) % b
                    left = (left - self._draw(tweak, n, i, right)) % a
                else:
                    left = (left + self._draw(tweak, n, i, right)) % a
                    right = (right + self._draw(tweak, n, i + 1, left)) % b
            x = left * b + right
            if x < n:
                return x

    def permute(self, x: int, n: int, tweak: str) -> int:
        """A bijection of [0, n) that is a single cycle: the next in a keyed order, so never x itself."""
        return x if n < 2 else self._feistel((self._feistel(x, n, tweak) + 1) % n, n, tweak, back=True)

    def string(self, s: str, sets: list[str], tweak: str) -> str:
        """A string whose i-th character is in sets[i] -> another one: a bijection of all such strings."""
        n, x = 1, 0
        for c, own in zip(s, sets, strict=True):
            n, x = n * len(own), x * len(own) + own.index(c)
        shape = hashlib.blake2b("\0".join(sets).encode(), digest_size=8).hexdigest()
        y, out = self.permute(x, n, f"{tweak}|{shape}"), []
        for own in reversed(sets):
            y, d = divmod(y, len(own))
            out.append(own[d])
        return "".join(reversed(out))

    def letters(self, s: str, tweak: str) -> str:
        """Letters among letters of their kind, digits among digits, in lower case; all else stays. Case is put back."""
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in s)
        at = [(i, own) for i, c in enumerate(low) if (own := _kind(c))]
        if at:
            new = iter(self.string("".join(low[i] for i, _ in at), [own for _, own in at], f"{tweak}|{''.join('_' if _kind(c) else c for c in low)}"))
            places = {i for i, _ in at}
            low = "".join(next(new) if i in places else c for i, c in enumerate(low))
        return "".join(c.upper() if o.isupper() and len(o.lower()) == len(c.upper()) == 1 else c for c, o in zip(low, s, strict=True))

    def digits(self, s: str, tweak: str, keep: int = 0) -> str:
        """Digits permuted after the first `keep`, all else in place."""
        at = [i for i, c in enumerate(s) if c in "0123456789"][keep:]
        new = iter(self.string("".join(s[i] for i in at), ["0123456789"] * len(at), f"{tweak}|{s[: at[0]] if at else ''}|{len(s)}"))
        places = set(at)
        return "".join(next(new) if i in places else c for i, c in enumerate(s))


@lru_cache(4096)
def _kind(c: str) -> str:
    if c in "0123456789":
        return "0123456789"
    return _tabled(c) or (_others()[c] if c.isalnum() else "")


def _tabled(c: str) -> str:
    return next((s for group in (VOWELS, CONSONANTS) for s in group.values() if c in s), "")


@lru_cache(1)
def _others() -> dict[str, str]:
    """Each letter, digit or number outside the tables -> those of its script and kind, itself among them.

    Upper case, letters that upper case brings back, and letters it does not are kept apart, so that case can be
    put back. Kinds of a single character are thrown together within these.
    """
    kinds: defaultdict[tuple, list[str]] = defaultdict(list)
    for i in range(128, 0x110000):
        c = chr(i)
        if c.isalnum() and not _tabled(c):
            if c.isdecimal():
                kind = ("digit", i - int(c))
            else:
                case = "odd" if len(c.lower()) > 1 else "upper" if c.lower() != c else "none" if c.upper() == c else "lower" if len(c.upper()) == 1 and c.upper().lower() == c else "odd"
                kind = (case, *unicodedata.name(c, "").split("-")[0].split()[:2], unicodedata.category(c)[0], i >> 16, 0x4E00 <= i <= 0x9FFF)
            kinds[kind].append(c)
    sets: defaultdict[tuple, str] = defaultdict(str)
    for kind, cs in kinds.items():
        sets[kind[:1] if len(cs) == 1 else kind] += "".join(cs)
    return {c: own for own in sets.values() for c in own}


def luhn(digits: str) -> int:
    """The check digit that follows these digits."""
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def email(c: Cipher, s: str) -> str:
    """Local part and domain labels apart, the last label kept; upper and lower case are the same address."""
    local, _, domain = s.rpartition("@")
    labels = domain.split(".")
    # An address at a name is one entity: the local part's map depends on the whole domain.
    return f"{c.letters(local, 'local|' + domain.lower())}@{'.'.join([c.letters('.'.join(labels[:-1]), 'domain'), labels[-1]])}"


def phone(c: Cipher, s: str) -> str:
    """The country code stays where it is set apart; brackets and blanks are not part of the number."""
    code = len(m[1]) if (m := re.match(r"\+(\d{1,3})\b", s)) else 0
    digits = re.sub(r"\D", "", s)
    new = iter(digits[:code] + c.string(digits[code:], ["0123456789"] * (len(digits) - code), f"phone|{digits[:code]}"))
    return "".join(next(new) if ch.isdigit() else ch for ch in s)


def card(c: Cipher, s: str) -> str:
    """All digits but the last permuted, the first among issuers'; the last is as far from the check digit as before, so valid stays valid."""
    digits = re.sub(r"\D", "", s)
    body = c.string(digits[:-1], ["23456" if digits[0] in "23456" else "01789", *["0123456789"] * (len(digits) - 2)], "card")
    new = iter(body + str((luhn(body) + int(digits[-1]) - luhn(digits[:-1])) % 10))
    return "".join(next(new) if ch.isdigit() else ch for ch in s)


def ipv4(c: Cipher, s: str) -> str:
    n = 0
    for part in s.split("."):
        n = n << 8 | int(part)
    n = c.permute(n, 1 << 32, "ipv4")
    return ".".join(str(n >> k & 255) for k in (24, 16, 8, 0))


def ipv6(c: Cipher, s: str) -> str:
    """The address permuted as a number, however it is written; its groups are written out where the entity's are."""
    new = IPv6Address(c.permute(int(IPv6Address(s)), 1 << 128, "ipv6"))
    out = str(new) if "::" in s else ":".join(f"{int(g, 16):x}" for g in new.exploded.split(":"))
    return out.upper() if s.isupper() else out


def iban(c: Cipher, s: str) -> str:
    """Country kept, check digits made valid again."""
    plain = s.replace(" ", "").upper()
    body = c.letters(plain[4:], f"iban|{plain[:2]}")
    value = int("".join(str(int(x, 36)) for x in f"{body}{plain[:2]}00"))
    new = iter(f"{plain[:2]}{98 - value % 97:02d}{body}".upper())
    return "".join(ch if ch == " " else next(new) for ch in s)


def secret(c: Cipher, s: str) -> str:
    """Hex stays hex; other tokens keep a prefix such as ghp_ and the kinds of their characters."""
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        new = c.string(s.lower(), ["0123456789abcdef"] * len(s), "hex")
        return new.upper() if s.isupper() else new
    head = re.match(r"gh[pousr]_|sk_(?:live|test)_|xox[abpr]-|AKIA|ASIA|", s)[0]
    head = head if any(x.isalnum() for x in s[len(head) :]) else ""
    sets = ["0123456789" if ch in "0123456789" else "abcdefghijklmnopqrstuvwxyz" if ch in "abcdefghijklmnopqrstuvwxyz" else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if ch in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else _kind(ch) or ch for ch in s[len(head) :]]
    return head + c.string(s[len(head) :], sets, f"secret|{head}")


def _script(word: str) -> str:
    c = word[0].lower()
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


_GENDER = {n: (script, g) for (script, g), names in GIVEN.items() for n in names}
#: Given names in lower case -> as they are written.
_GIVEN = {n.lower(): n for n in _GENDER}
_TITLE_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_KNOWN = {*_GIVEN, *(t.lower() for t in _TITLE_GENDER)}


def name(c: Cipher, s: str) -> str:
    """Given names change within gender and script, other names letter by letter; titles, initials and blanks stay."""
    out = []
    for part in re.split(r"(\s+)", s):
        word = part.rstrip(".")
        if not word.strip() or word in _TITLE_GENDER or len(word) == 1:
            out.append(part)
        elif word.lower() in _GIVEN:
            given = _GIVEN[word.lower()]
            names = GIVEN[_GENDER[given]]
            new = names[c.permute(names.index(given), len(names), "given|" + "|".join(_GENDER[given]))]
            out.append((new.upper() if word.isupper() else new) + part[len(word) :])
        else:
            # A surname that comes out as a given name or title would share it: on to the next of the cycle.
            new = c.letters(word, f"surname|{_script(word)}")
            while new.lower() in _KNOWN:
                new = c.letters(new, f"surname|{_script(word)}")
            out.append(new + part[len(word) :])
    return "".join(out)


#: Marks that belong to the letter before them, such as vowel signs.
_MARKS = "".join(c for c in map(chr, range(0x300, 0x10000)) if unicodedata.category(c)[0] == "M")
_REST = rf"[^\W\d_]*(?:[{_MARKS}]+[^\W\d_]*)*"
_WORD = rf"[^\W\d_a-zß-öø-ÿа-яёα-ωά-ώ](?:[^\W\d_]|[{_MARKS}]){_REST}(?:['’-][^\W\d_]{{2}}{_REST})?"
_FULL = rf"(?:[ \t]+(?:[^\W\d_]\.[ \t]+)?{_WORD}){{1,2}}"


_TITLE = rf"(?:{'|'.join(_TITLE_GENDER)})\b\.?"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: re.Pattern[str]
    surrogate: Callable[[Cipher, str], str]
    needs: str  # the entry of _NEEDS that finds something in every text that holds one
    valid: Callable[[str], bool] = lambda s: True


def _some(s: str) -> bool:
    """Not just a line to fill in."""
    return any(x.isalnum() for x in s)


def _address(s: str) -> bool:
    """Something before the last label that is not just signs."""
    return _some(s.rpartition(".")[0])


def _named(s: str) -> bool:
    """A word besides titles and initials."""
    return any(len(w) > 1 and w not in _TITLE_GENDER for w in s.replace(".", " ").split())


def _numbers(surrogate: Callable[[Cipher, str], str]) -> Callable[[Cipher, str], str]:
    """Digits of any script: the number's surrogate, in the digits of its first one that is not ASCII."""

    def run(c: Cipher, s: str) -> str:
        new = surrogate(c, "".join(str(int(x)) if x.isdecimal() else x for x in s))
        own = next((ord(x) - int(x) for x in s if x.isdecimal() and not x.isascii()), None)
        return new if own is None else "".join(chr(own + int(x)) if x in "0123456789" else x for x in new)

    return run


def _octets(s: str) -> bool:
    return all(int(x) < 256 for x in s.split("."))


def _ipv6_like(s: str) -> bool:
    try:
        return len(s) >= 7 and any(x.isdigit() for x in s) and IPv6Address(s) is not None
    except ValueError:
        return False


def _card_like(s: str) -> bool:
    """An issuer's first digit, and the check digit that belongs to the others."""
    digits = "".join(str(int(x)) for x in s if x.isdecimal())
    return digits[0] in "23456" and luhn(digits[:-1]) == int(digits[-1])


def _secret_like(s: str) -> bool:
    """A short value counts if it has letters and digits: plain words follow such names in prose too."""
    return _some(s) and (len(s) >= 16 or (any(x.isdigit() for x in s) and any(x.isalpha() for x in s)))


def _iban_like(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(x, 36)) for x in s[4:] + s[:4])) % 97 == 1


#: In order of precedence; group 1 is the entity where a pattern has context.
KINDS = (
    Kind("email", re.compile(r"(?<![\w.+-])[\w.+-]+@(?:[\w-]+\.)+[^\W\d_]{2,}(?![\w-])"), email, "@", _address),
    Kind("secret", re.compile(r"(?i)\b(?:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|pwd|auth)\b[ \t]*+[!#$%&*]*+[ \t]*+[=:]++[ \t]*+[!#$%&*]*+[ \t]*+[\"']?([\w/+-]{8,})"), secret, "=", _secret_like),
    Kind("secret", re.compile(r"\b((?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_\w{36,}|sk_(?:live|test)_\w{16,}|xox[abpr]-[\w-]{10,})"), secret, "AKIA", _some),
    Kind("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), _numbers(iban), "0", _iban_like),
    Kind("ip", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"), _numbers(ipv4), "0", _octets),
    Kind("ip", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,7}(?:[0-9A-Fa-f]{1,4}|(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:]|\.\d)"), ipv6, "=", _ipv6_like),
    Kind("card", re.compile(r"(?<![\w.+-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])"), _numbers(card), "0", _card_like),
    Kind("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), _numbers(lambda c, s: c.digits(s, "ssn")), "0"),
    Kind("phone", re.compile(r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,5}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])"), _numbers(phone), "0"),
    Kind("name", re.compile(rf"\b{_TITLE}(?:[ \t]+{_TITLE}){{0,4}}{_FULL}"), name, "", _named),
    Kind("name", re.compile(rf"(?<!\w)(?:{'|'.join(n for ns in GIVEN.values() for n in ns)}){_FULL}(?!\w)"), name, ""),
)
#: Cheap necessary conditions. A secret needs no digit: its sign or its prefix is what every one has.
_NEEDS = {
    "@": re.compile("@"),
    "=": re.compile("[=:]"),
    "AKIA": re.compile("A[KS]IA|gh[pousr]_|sk_(?:live|test)_|xox[abpr]-"),
    "0": re.compile(r"\d"),
    "": re.compile(rf"\b(?:{'|'.join([*_TITLE_GENDER, *_GENDER])})\b"),
}


def entities(text: str) -> list[tuple[int, int, Kind]]:
    """(start, end, kind) of entities in order, without overlaps: of two that overlap the earlier kind holds, then the first.

    The time grows with the text and its entities: taken spans are kept in order and found by bisection.
    """
    has = {k: p.search(text) is not None for k, p in _NEEDS.items()}
    starts: list[int] = []
    taken: list[tuple[int, int, Kind]] = []
    for kind in KINDS if any(has.values()) else ():
        if has[kind.needs]:
            for m in kind.pattern.finditer(text):
                start, end = m.span(1) if m.re.groups else m.span()
                at = bisect_left(starts, end)  # the last span that begins before the end is the only one to overlap
                if (not at or taken[at - 1][1] <= start) and kind.valid(text[start:end]):
                    starts.insert(at, start)
                    taken.insert(at, (start, end, kind))
    return taken


def replace(text: str, cipher: Cipher) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (kind, entity, surrogate) of each replacement."""
    out, at, done = [], 0, []
    for start, end, kind in entities(text):
        new = kind.surrogate(cipher, text[start:end])
        done.append((kind.name, text[start:end], new))
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), done


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("entity", pa.string()), ("surrogate", pa.string())]))


def surrogates(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """All columns of docs with `column` replaced, and pii: array of (kind, entity, surrogate) in text order.

    A null text stays null and an empty one empty, with an empty array; a column named pii is replaced,
    others may have any name. Texts are treated whole, however long, and each by itself, so there is no
    shuffle, repeated rows give repeated results, an empty table an empty one, and equal entities get
    equal surrogates under equal keys. Where entities overlap see `entities`.
    """
    own = docs.drop("pii")
    fields = own.schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", pii array<struct<kind: string, entity: string, surrogate: string>>"
    names = [*own.columns, "pii"]
    at = names.index(column)

    def run(batches: Iterable[pa.RecordBatch]):
        cipher = Cipher(key.encode())
        for batch in batches:
            texts, found = [], []
            for t in batch.column(at).to_pylist():
                new, done = replace(t, cipher) if t else (t, [])
                texts.append(new)
                found.append([dict(zip(("kind", "entity", "surrogate"), d, strict=True)) for d in done])
            cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(found, _FOUND)], names)

    return own.mapInArrow(run, schema)


def collisions(replaced: DataFrame) -> DataFrame:
    """kind, surrogate, entities: surrogates that stand for more than one entity (letter case and format apart), over all rows."""
    each = replaced.select(F.explode("pii").alias("p")).select("p.*")
    plain = lambda c: F.when(F.col("kind").isin("phone", "card"), F.regexp_replace(c, r"\D", "")).otherwise(F.lower(c))
    return each.select("kind", plain("surrogate").alias("surrogate"), plain("entity").alias("entity")).distinct().groupBy("kind", "surrogate").agg(F.count("*").alias("entities")).filter("entities > 1")


def checked(replaced: DataFrame) -> DataFrame:
    """replaced, written, after a pass over all its entities has found no surrogate of two; raises otherwise."""
    replaced = cut(replaced)
    shared = collisions(replaced).count()
    if shared:
        raise ValueError(f"{shared} surrogates stand for more than one entity")
    return replaced
