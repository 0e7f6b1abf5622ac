"""Parsing of titles and credits into their parts."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

from linkwright.functions.arrow import normalized
from linkwright.functions.notes import LANGUAGES, TAGS, annotates, names_work
from linkwright.functions.text import PLACEHOLDER_ARTISTS

CRITICAL_TAGS = ["live", "remix", "instrumental", "acoustic", "demo", "cover", "piano", "guitar", "orchestral", "sped_up", "slowed", "tv_size", "alternate_cut"]
PROJECTS = ["hoyofair", "hoyo-mix", "hoyomix", "riot games music", "project sekai", "monstercat", "a-sketch", "vocaloid", "san-z", "三z-studio", "三z工作室", "bandai namco", "square enix music", "capcom sound team", "sega sound team", "nintendo", "arcaea", "rayark", "bilibili", "netease cloud music", "qq music", "mihoyo", "hypergryph", "塞壬唱片", "monster siren records", "siren records"]

_BRACKET = re.compile(r"[(\[（【]([^()\[\]（）【】]*)[)\]）】]")
_FEATURED = re.compile(r"(?i)\s*[(\[（【]?\s*(?:feat\.?|ft\.?|featuring)\s+([^)\]）】]+)[)\]）】]?")
_COVERED = re.compile(r"(?i)^(?:cover|翻唱|翻自|原唱)[:：\s]+(.+)$")
_QUOTES = re.compile("[《》「」『』“”\"]")


def _has(word: str, text: str) -> bool:
    """Latin words count as whole words, others anywhere."""
    return bool(re.search(rf"(?<![a-z0-9]){re.escape(word)}(?![a-z])", text)) if word.isascii() else word in text


def version_tags(text: str) -> list[str]:
    t = normalized(text)
    return [tag for tag, words in TAGS.items() if any(_has(w, t) for w in words)]


def language_version(text: str) -> str | None:
    t = normalized(text)
    return next((lang for lang, words in LANGUAGES.items() if any(w in t for w in words)), None)


def _annotates(text: str) -> bool:
    """Whether a part of a title describes a version of the work; a tag anywhere in it is enough."""
    return annotates(text) or bool(version_tags(text)) or language_version(text) is not None


@lru_cache(1 << 16)
def parse_title(title: str | None) -> dict:
    """core, tags, language, credits, work source, covered entity, and the title's own variants."""
    raw = (title or "").strip()
    credits = [n.strip() for m in _FEATURED.finditer(raw) for n in re.split(r"[,，、/&]", m.group(1)) if n.strip()]
    core = _FEATURED.sub(" ", raw)
    notes, variants, source, covered = [], [], None, None
    for inner in (m.group(1).strip() for m in _BRACKET.finditer(core)):
        hit = _COVERED.match(inner)
        covered = covered or (hit.group(1).strip() if hit else None)
        if names_work(inner):
            source = source or inner
            notes.append(inner)
        elif hit or _annotates(inner):
            notes.append(inner)
        elif inner:
            variants.append({"text": inner, "provenance": "bracket", "speculative": False})
    while (shorter := _BRACKET.sub(" ", core)) != core:
        core = shorter
    parts = re.split(r"\s+[-/／]\s+|\s*[–—]\s*", core.strip())
    while len(parts) > 1 and _annotates(parts[-1]):
        notes.append(parts.pop())
    for extra in parts[1:]:
        variants.append({"text": extra.strip(), "provenance": "dash", "speculative": True})
    core = re.sub(r"\s+", " ", _QUOTES.sub("", parts[0] if len(parts) > 1 and variants else " - ".join(parts))).strip() or raw
    seen, kept = {core.lower()}, []
    for v in variants:
        plain = re.sub(r"\s+", " ", _QUOTES.sub("", v["text"])).strip()
        if plain.lower() not in seen and (len(plain) >= 2 or not plain.isascii()):
            seen.add(plain.lower())
            kept.append(v | {"text": plain})
    about = " ".join(notes)
    return {"core": core, "tags": version_tags(about), "language": language_version(about), "credits": list(dict.fromkeys(credits)), "work_source": source, "covered": covered, "variants": kept[:4]}


NAMES = ArrayType(StringType())
VARIANT = StructType().add("text", StringType()).add("provenance", StringType()).add("speculative", BooleanType())
TITLE = StructType().add("core", StringType()).add("tags", NAMES).add("language", StringType()).add("credits", NAMES).add("work_source", StringType()).add("covered", StringType()).add("variants", ArrayType(VARIANT))


@F.pandas_udf(TITLE)
def title_parts(title: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_title(t) for t in title], columns=["core", "tags", "language", "credits", "work_source", "covered", "variants"])


_ROLE = re.compile(r"(?i)^(?:vocals?|演唱|歌|词|曲|编曲|作词|作曲)\s*[:：]\s*")
_VOICE = re.compile(r"(?i)^(.*?)\s*[(（]\s*(?:cv|voice)\s*[:：.]?\s*(.+?)\s*[)）]$")
_ALIAS = re.compile(r"^(.*?)\s*[(（]\s*(.+?)\s*[)）]$")


def parse_artists(names: list[str] | None, credits: list[str] | None = None) -> dict:
    """primary, featured, voices, collaborators, aliases, project of a credit list, in order."""
    out: dict[str, list[str]] = {"featured": list(credits or []), "voices": [], "collaborators": [], "aliases": []}
    primary, project = "", None
    for name in names if names is not None else []:
        main, *guests = re.split(r"(?i)\s+(?:feat\.?|ft\.?|featuring|with)\s+", _ROLE.sub("", (name or "").strip()))
        out["featured"] += [g.strip() for guest in guests for g in re.split(r"[,，、/&]", guest) if g.strip()]
        for piece in re.split(r"\s*[/、&+×]\s*", main):
            piece = piece.strip().strip("\"“”'")
            if (m := _VOICE.match(piece)) is not None:
                piece = m.group(1).strip()
                out["voices"].append(m.group(2))
            elif (m := _ALIAS.match(piece)) is not None and m.group(1):
                piece = m.group(1).strip()
                out["aliases"].append(m.group(2))
            if not piece or piece.lower() in PLACEHOLDER_ARTISTS:
                continue
            project = project or (piece if piece.lower() in PROJECTS else None)
            if not primary:
                primary = piece
            elif piece != primary:
                out["collaborators"].append(piece)
    others = list(dict.fromkeys(n for k in ("collaborators", "featured", "voices", "aliases") for n in out[k] if n != primary))
    return {"primary": primary, **{k: list(dict.fromkeys(v)) for k, v in out.items()}, "others": others, "project": project}


ARTISTS = StructType().add("primary", StringType())
for _name in ("featured", "voices", "collaborators", "aliases", "others"):
    ARTISTS = ARTISTS.add(_name, NAMES)
ARTISTS = ARTISTS.add("project", StringType())


@F.pandas_udf(ARTISTS)
def artist_parts(names: pd.Series) -> pd.DataFrame:
    # many tracks of a batch have the same artists
    lists = [None if n is None else tuple(n) for n in names]
    found = {n: parse_artists(None if n is None else list(n)) for n in set(lists)}
    return pd.DataFrame([found[n] for n in lists], columns=["primary", "featured", "voices", "collaborators", "aliases", "others", "project"])
