"""Canonical column names: one spelling for what providers call open, close, sma20, +di14 and so on."""

from __future__ import annotations

import re
import unicodedata

#: Spellings of the bar columns.
BAR_NAMES = {
    "tarih": "date",
    "date": "date",
    "kapanis": "close",
    "close": "close",
    "acilis": "open",
    "open": "open",
    "yuksek": "high",
    "high": "high",
    "dusuk": "low",
    "low": "low",
    "hacim": "volume",
    "islem_hacmi": "volume",
    "lot": "volume",
    "volume": "volume",
}

#: Indicator families and their canonical prefix; parameters follow, joined by underscores.
FAMILIES = {"sma": "sma", "ema": "ema", "rsi": "rsi", "adx": "adx", "bbu": "bbu", "bbupper": "bbu", "bbm": "bbm", "bbmid": "bbm", "bbl": "bbl", "bblower": "bbl", "+di": "plus_di", "-di": "minus_di"}

#: Names that a file loader writes in full, stems that it spells out, and names that swallow what follows.
LOADER_NAMES = {"cci_20_0": "cci_20", "psarl_0": "psarl_0_02_0_2"}
LOADER_STEMS = {"aroonu": "aroon_up", "aroond": "aroon_down"}
LOADER_HEADS = ("bbm_20_2", "bbu_20_2")

_DOTLESS = str.maketrans({"ı": "i", "İ": "i"})
_FAMILY = re.compile(r"(?P<head>[+-]di|[a-z]+)[_.]?(?P<args>\d+(?:[_.]\d+(?:[.p]\d+)?)?)")


def fold(name: str) -> str:
    """Lower case without accents or dotless letters."""
    plain = unicodedata.normalize("NFKD", name.translate(_DOTLESS))
    return "".join(c for c in plain if not unicodedata.combining(c)).lower()


def _parameter(text: str) -> str:
    """2.5 -> 2p5 and 2.0 or 2p0 -> 2: only a trailing p0 goes."""
    return re.sub(r"p0+$", "", text.replace(".", "p"))


def canonical(name: str, aliases: dict[str, str] | None = None) -> str:
    """The canonical snake_case form of a column name; `aliases` (exact spellings) come first."""
    if not name.strip():
        return ""
    if aliases and name.strip() in aliases:
        return aliases[name.strip()]
    text = fold(name.strip())
    signed = text[0] in "+-"
    body = re.sub(r"[\s-]+", "_", text[1:] if signed else text)
    text = (text[0] if signed else "") + re.sub(r"_{2,}", "_", body)
    if text in BAR_NAMES:
        return BAR_NAMES[text]
    if (m := _FAMILY.fullmatch(text)) and m["head"] in FAMILIES:
        first, *more = re.split(r"[_.]", m["args"], maxsplit=1)
        return "_".join([FAMILIES[m["head"]], first, *map(_parameter, more)])
    return "_".join(_parameter(x) if re.fullmatch(r"\d+[.p]\d+", x) else x for x in text.split("_"))


def without_copy_number(name: str, columns: list[str]) -> str:
    """Close.1 -> Close, where the header also has Close or Close is a bar column: readers number repeated headers."""
    base = re.sub(r"\.\d+$", "", name)
    return base if base in columns or fold(base.strip()) in BAR_NAMES else name


def canonical_map(columns: list[str], aliases: dict[str, str] | None = None) -> dict[str, str]:
    return {c: canonical(without_copy_number(c, columns), aliases) for c in columns}


def loader_name(name: str) -> str:
    """A canonical name as a file loader settles it: cci_20_0, psarl_0, aroonu_14, bbm_20_2_x."""
    stem, _, rest = name.partition("_")
    if stem in LOADER_STEMS and rest:
        return f"{LOADER_STEMS[stem]}_{rest}"
    return LOADER_NAMES.get(name) or next((h for h in LOADER_HEADS if name.startswith(h)), name)
