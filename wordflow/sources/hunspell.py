"""Hunspell dictionaries: .aff and .dic files into flat records."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class DictionaryError(ValueError):
    """A dictionary file that can't be read."""


#: Encodings that SET may name.
ENCODINGS = {"UTF-8": "utf-8", "UTF8": "utf-8", "ISO8859-1": "iso-8859-1", "ISO-8859-1": "iso-8859-1", "ISO8859-2": "iso-8859-2", "ISO-8859-2": "iso-8859-2", "ISO8859-15": "iso-8859-15", "ISO-8859-15": "iso-8859-15"}
#: Directives of one flag, by attribute.
FLAG_DIRECTIVES = {
    "COMPOUNDFLAG": "compound", "COMPOUNDBEGIN": "compound_begin", "COMPOUNDMIDDLE": "compound_middle", "COMPOUNDEND": "compound_end", "COMPOUNDLAST": "compound_end",
    "COMPOUNDPERMITFLAG": "compound_permit", "COMPOUNDFORBIDFLAG": "compound_forbid", "ONLYINCOMPOUND": "only_in_compound", "KEEPCASE": "keep_case", "NEEDAFFIX": "need_affix",
    "PSEUDOROOT": "need_affix", "CIRCUMFIX": "circumfix", "FORBIDDENWORD": "forbidden", "FORCEUCASE": "force_ucase", "NOSUGGEST": "no_suggest",
}
#: Directives that are true wherever they stand.
SWITCHES = {"COMPLEXPREFIXES": "complex_prefixes", "CHECKSHARPS": "check_sharps", "CHECKCOMPOUNDCASE": "check_case", "CHECKCOMPOUNDDUP": "check_dup", "CHECKCOMPOUNDREP": "check_rep", "CHECKCOMPOUNDTRIPLE": "check_triple", "SIMPLIFIEDTRIPLE": "simplified_triple"}


@dataclass(frozen=True)
class Affix:
    kind: str  # PFX or SFX
    flag: str
    cross: bool
    strip: str
    add: str
    condition: str  # an anchored regular expression
    flags: frozenset[str]


@dataclass
class Affixes:
    """Everything an .aff file says that has an effect."""

    flag_format: str = "short"
    aliases: dict[str, str] = field(default_factory=dict)
    affixes: list[Affix] = field(default_factory=list)
    try_: str = ""
    lang: str = ""
    ignore: str = ""
    rep: list[tuple[str, str]] = field(default_factory=list)
    iconv: list[tuple[str, str]] = field(default_factory=list)
    breaks: list[str] = field(default_factory=lambda: ["-", "^-", "-$"])
    compound_min: int = 3
    compound_words: int = 0
    compound_rules: list[list[tuple[str, str]]] = field(default_factory=list)
    compound_patterns: list[tuple[str, str, str]] = field(default_factory=list)
    single: dict[str, str] = field(default_factory=dict)
    switches: set[str] = field(default_factory=set)

    def flag(self, name: str) -> str | None:
        return self.single.get(name)


def encoding_of(data: bytes) -> str:
    """The SET line, else UTF-8 if the bytes are, else Latin-1."""
    found = re.search(rb"^\s*SET\s+(\S+)", data, re.MULTILINE)
    if found:
        name = found[1].decode("ascii", "replace").upper()
        if name not in ENCODINGS:
            raise DictionaryError(f"unsupported encoding {name}")
        return ENCODINGS[name]
    try:
        data.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        return "iso-8859-1"


def lines_of(data: bytes, encoding: str) -> list[str]:
    """Stripped, non-empty lines; a byte-order mark goes, lines that don't decode are Latin-1."""
    out = []
    for raw in data.removeprefix(b"\xef\xbb\xbf").splitlines():
        raw = raw.strip(b" \t\r\n\x0b\x0c\0")
        if raw:
            try:
                out.append(raw.decode(encoding))
            except UnicodeDecodeError:
                out.append(raw.decode("iso-8859-1"))
    return out


def to_int(text: str) -> int:
    """Leading integer, else 0."""
    found = re.match(r"\s*([+-]?\d+)", text)
    return int(found[1]) if found else 0


def split_flags(text: str, style: str) -> list[str]:
    if style == "long":
        return [text[i : i + 2] for i in range(0, len(text) - 1, 2)]
    return re.findall(r"\d+", text) if style == "num" else list(text)


def condition_regex(text: str) -> str:
    """One character a token: any, a class (a dash is itself), or a literal."""
    out = []
    for token in re.findall(r"\[\^?[^\]]*\]|.", text):
        if token == ".":
            out.append(".")
        elif token[0] == "[" and len(token) > 2:
            negated = token[1] == "^"
            inner = re.sub(r"([\\\]\[^\-&~|])", r"\\\1", token[1 + negated : -1])
            out.append(f"[{'^' * negated}{inner}]")
        else:
            out.append(re.escape(token))
    return "".join(out)


def parse_aff(data: bytes | str) -> Affixes:
    data = data.encode() if isinstance(data, str) else data
    lines, at = lines_of(data, encoding_of(data)), 0
    aff = Affixes()

    def block(count: str) -> list[list[str]]:
        nonlocal at
        n = to_int(count)
        if at + n > len(lines):
            raise DictionaryError("truncated block")
        at += n
        return [x.split() for x in lines[at - n : at]]

    def flags(text: str) -> frozenset[str]:
        return frozenset(split_flags(aff.aliases.get(text, text), aff.flag_format))

    while at < len(lines):
        name, *args = lines[at].split()
        at += 1
        first = args[0] if args else ""
        if not re.fullmatch("[A-Z]+", name):
            continue
        if name == "FLAG":
            aff.flag_format = {"long": "long", "num": "num"}.get(first, "short")
        elif name in SWITCHES:
            aff.switches.add(SWITCHES[name])
        elif name in FLAG_DIRECTIVES:
            aff.single[FLAG_DIRECTIVES[name]] = first
        elif name in ("TRY", "LANG", "IGNORE"):
            setattr(aff, {"TRY": "try_", "LANG": "lang", "IGNORE": "ignore"}[name], first)
        elif name == "COMPOUNDMIN":
            aff.compound_min = to_int(first)
        elif name == "COMPOUNDWORDMAX":
            aff.compound_words = to_int(first)
        elif name == "AF":
            aff.aliases = {str(i): row[1] for i, row in enumerate(block(first), 1)}
        elif name in ("REP", "ICONV"):
            pairs = [(r[1], r[2] if len(r) > 2 else "") for r in block(first)]
            setattr(aff, name.lower(), [*getattr(aff, name.lower()), *pairs])
        elif name == "BREAK":
            aff.breaks = [r[1] for r in block(first)]
        elif name == "COMPOUNDRULE":
            aff.compound_rules += [_rule(r[1], aff.flag_format) for r in block(first)]
        elif name == "CHECKCOMPOUNDPATTERN":
            aff.compound_patterns += [(r[1], r[2], r[3] if len(r) > 3 else "") for r in block(first)]
        elif name in ("OCONV", "MAP", "PHONE", "AM"):
            block(first)
        elif name in ("SFX", "PFX") and len(args) >= 3:
            for row in block(args[2]):
                add, _, more = (row[3] if len(row) > 3 else "0").partition("/")
                strip = "" if row[2] == "0" else row[2]
                condition = condition_regex(row[4]) if len(row) > 4 and row[4] != "." else ""
                condition = condition and (f"(?:{condition})$" if name == "SFX" else f"^(?:{condition})")
                aff.affixes.append(Affix(name, first, args[1] == "Y", strip, "" if add == "0" else add, condition, flags(more) if more else frozenset()))
    return aff


def _rule(text: str, style: str) -> list[tuple[str, str]]:
    """(flag, quantifier) items of a compound rule; flags of more than one character in brackets."""
    return [(long or one, quantifier) for long, one, quantifier in re.findall(r"(?:\(([^)]+)\)|(.))([*?]?)", text)]


@dataclass(frozen=True)
class Entry:
    stem: str
    flags: frozenset[str]


def parse_dic(data: bytes | str, aff: Affixes, encoding: str = "utf-8") -> tuple[list[Entry], list[tuple[str, str]]]:
    """(entries in file order, replacement pairs of ph: fields)."""
    data = data.encode() if isinstance(data, str) else data
    entries, reps = [], []
    lines = lines_of(data, encoding)
    for line in lines[1:] if lines and re.match(r"\d+", lines[0]) else lines:
        if "\t" in line:
            word, _, morph = line.partition("\t")
        else:
            found = re.search(r"\s+(?=\w{2}:\S)", line)
            word, morph = (line[: found.start()], line[found.end() :]) if found else (line, "")
        cut = re.search(r"(?<!\\)/", word[1:])
        stem, flag_text = (word[: cut.start() + 1], word[cut.end() + 1 :]) if cut else (word, "")
        stem = stem.replace("\\/", "/").strip()
        if aff.aliases and flag_text.strip().isdigit():
            flag_text = aff.aliases.get(flag_text.strip(), "")
        for hint in re.findall(r"\bph:(\S+)", morph):
            if "->" in hint:
                reps.append(tuple(hint.split("->", 1)))
            elif hint.endswith("*"):
                reps.append((hint[:-2], stem[:-1]))
            else:
                reps.append((hint, stem))
        if aff.ignore:
            stem = stem.translate({ord(c): None for c in aff.ignore})
        entries.append(Entry(stem, frozenset(split_flags(flag_text.strip(), aff.flag_format))))
    return entries, reps
