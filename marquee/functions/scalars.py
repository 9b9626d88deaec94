"""Scalar columns: recency, names, paths, escapes, file kinds and seeded draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZERO_WIDTH = "\u200b"
# File kinds.
MEDIA = ("mp3", "flac", "m4a", "wav", "ogg", "mkv", "mp4", "avi", "m4v", "wmv", "ts", "mov", "iso")
SIDECARS = ("jpg", "jpeg", "png", "tbn", "nfo")


def parse_played(text: Column, keep_offsets: bool = True) -> Column:
    """A played time as UTC timestamp_ntz; None where it can't be parsed.

    `Z` is dropped anywhere. A time with an offset is taken to UTC, or with keep_offsets=False
    counts as unparsable.
    """
    plain = F.replace(text, F.lit("Z"), F.lit(""))
    offset = plain.rlike(r"[+-]\d\d:\d\d$")
    with_offset = F.to_utc_timestamp(plain.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz") if keep_offsets else F.lit(None).cast("timestamp_ntz")
    return F.when(offset, with_offset).otherwise(plain.try_cast("timestamp_ntz"))


def recency_tenths(last_played: Column, as_of: str) -> Column:
    """Recency multiplier in tenths, by full days of 24 hours: 15, 10, 6, 3; 7 without a time."""
    days = F.timestamp_diff("DAY", last_played, F.lit(as_of).cast("timestamp_ntz"))
    return F.when(last_played.isNull(), 7).when(days < 30, 15).when(days < 90, 10).when(days < 365, 6).otherwise(3)


def safe_name(name: Column, n: int = 50) -> Column:
    """Letters, digits, space, - and _; at most n characters, without spaces at the ends."""
    return F.trim(F.substring(F.trim(F.regexp_replace(name, r"[^\p{L}\p{N} _-]", "")), 1, n))


def artist(album_artist: Column, artists: Column) -> Column:
    """The album's artist, else the first artist, else Unknown; an empty one counts as missing."""
    return F.coalesce(F.nullif(album_artist, F.lit("")), F.when(F.size(artists) > 0, F.try_element_at(artists, F.lit(1))), F.lit("Unknown"))


def escape_xml(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def resolve_path(path: Column, rules: list[tuple[str, str]], enabled: bool = True) -> Column:
    """The first rule whose prefix matches replaces it; otherwise the path stays."""
    out = path
    for prefix, to in reversed(rules if enabled else []):
        out = F.when(F.startswith(path, F.lit(prefix)), F.concat(F.lit(to), F.substring(path, F.lit(len(prefix) + 1), F.length(path)))).otherwise(out)
    return out


def resolve_drive(path: Column, drives: list[tuple[str, str]], substituted: Column | None = None) -> Column:
    """A drive's two characters become its network share, whatever their case.

    `substituted` is resolve_path's result, which wins where it changed the path.
    """
    out = path
    for drive, share in reversed(drives):
        out = F.when(F.startswith(F.upper(path), F.lit(drive.upper())), F.concat(F.lit(share), F.substring(path, F.lit(len(drive) + 1), F.length(path)))).otherwise(out)
    return out if substituted is None else F.when(substituted != path, substituted).otherwise(out)


#: Prefixes that are broadcast, or looked up as settings, instead of being joined by a shuffle.
MOST_SHARED = 20_000


def first_rules(rules: DataFrame) -> DataFrame:
    """One rule a prefix: the first by ordinal (then by replacement). The others never win."""
    first = F.min(F.struct("ordinal", "replacement")).alias("first")
    return rules.where("prefix IS NOT NULL").groupBy("prefix").agg(first).select("first.ordinal", "prefix", "first.replacement")


def resolve_by_table(items: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """resolve_path for rules in a table (ordinal, prefix, replacement): adds `resolved`.

    Prefixes meet paths by their text in an equi-join, so that many rules need no comparison of each
    path with each rule; of rules with one prefix only the first takes part. Short prefixes are few
    and each is shared by many paths: up to MOST_SHARED of them, whole lengths at a time, are
    broadcast, so that no task holds all paths of one. The longer ones meet by a shuffle. Of rules with
    one ordinal the first by prefix wins.
    """
    first = first_rules(rules)
    sizes = sorted((r.n, r.many) for r in first.groupBy(F.length("prefix").alias("n")).agg(F.count(F.lit(1)).alias("many")).collect())  # no more rows than the longest prefix has characters
    shared, taken = [], 0
    for n, many in sizes:
        if taken + many > MOST_SHARED:
            break
        shared.append(n)
        taken += many
    long = [n for n, _ in sizes if n not in shared]

    def matches(lengths: list[int], hint: str) -> DataFrame:
        fit = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length(path))
        keyed = items.select("item_id", path, F.explode(fit).alias("n")).select("item_id", F.substring(F.col(path), F.lit(1), F.col("n")).alias("prefix"))
        some = first.where(F.length("prefix").isin(lengths) if lengths else F.lit(False))
        return keyed.join(some.hint(hint), "prefix").groupBy("item_id").agg(F.min(F.struct("ordinal", "prefix", "replacement")).alias("rule"))

    best = matches(shared, "broadcast").unionByName(matches(long, "merge")).groupBy("item_id").agg(F.min("rule").alias("rule"))
    joined = items.join(best.hint("merge"), "item_id", "left")
    changed = F.concat(F.col("rule.replacement"), F.substring(F.col(path), F.length("rule.prefix") + 1, F.length(path)))
    return joined.withColumn("resolved", F.when(F.col("rule").isNull(), F.col(path)).otherwise(changed)).drop("rule")


#: Rules that resolve_by_rules takes; more of them meet paths in a join (resolve_by_table).
MOST_RULES = 100_000


def _flat_rules(rules: list[tuple[int, str, str]]) -> tuple[list[bytes], list[int]]:
    """The prefixes' trie laid out flat: the places where the first matching rule changes, and its index from there on (-1: none).

    Strings with a prefix are a range of all strings, and ranges of prefixes nest or lie apart.
    """
    best: dict[bytes, int] = {}
    for k in sorted(range(len(rules)), key=lambda k: rules[k][0]):
        best.setdefault(rules[k][1].encode(), k)
    events: list[tuple[bytes, int]] = [(b"", -1)]
    open_ranges: list[tuple[bytes | None, int]] = [(None, -1)]  # ends and winners, innermost last

    def close(until: bytes | None) -> None:
        while len(open_ranges) > 1 and (until is None or (open_ranges[-1][0] is not None and open_ranges[-1][0] <= until)):
            end, _ = open_ranges.pop()
            if end is not None:
                events.append((end, open_ranges[-1][1]))

    for prefix in sorted(best):
        close(prefix)
        around, own = open_ranges[-1][1], best[prefix]
        winner = own if around < 0 or rules[own][0] < rules[around][0] else around
        head = prefix.rstrip(b"\xff")
        open_ranges.append((head[:-1] + bytes([head[-1] + 1]) if head else None, winner))
        events.append((prefix, winner))
    close(None)
    flat = dict(events)  # the last event of a place counts
    return list(flat), list(flat.values())


def resolve_by_rules(path: Column, rules: list[tuple[int, str, str]]) -> Column:
    """resolve_path for thousands of rules (ordinal, prefix, replacement): each path is looked up once, by halving.

    The first rule by ordinal whose prefix matches replaces it; other paths stay, a null one too.
    """
    if not rules:
        return path
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules are more than {MOST_RULES}; use resolve_by_table")
    starts, winners = _flat_rules(rules)
    places, which = F.lit(starts), F.lit(winners)
    raw = path.cast("binary")
    low, high = F.lit(1).alias("low"), F.lit(len(starts) + 1).alias("high")  # the greatest place that isn't above the path
    middle = lambda x: F.floor((x["low"] + x["high"]) / 2).cast("int")

    def halve(x: Column, _: Column) -> Column:
        above = F.element_at(places, middle(x)) > raw
        wide = x["high"] - x["low"] > 1
        return F.struct(F.when(wide & ~above, middle(x)).otherwise(x["low"]).alias("low"), F.when(wide & above, middle(x)).otherwise(x["high"]).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(max(1, len(starts).bit_length())))
    rule = F.element_at(which, F.aggregate(steps, F.struct(low, high), halve)["low"])
    texts, sizes = F.lit([r[2] for r in rules]), F.lit([len(r[1]) for r in rules])
    return F.when(path.isNull() | (rule < 0), path).otherwise(F.concat(F.element_at(texts, rule + 1), F.substring(path, F.element_at(sizes, rule + 1) + 1, F.length(path))))


def display_name(base: Column, ordinal: Column) -> Column:
    """The base name and ordinal + 1 zero-width spaces, which make it a user's own."""
    return F.concat(base, F.repeat(F.lit(ZERO_WIDTH), (ordinal + 1).cast("int")))


def file_action(ext: Column, is_music: Column) -> Column:
    """What becomes of a file: media is linked (music) or pointed to (strm), sidecars are copied, others are null."""
    low = F.lower(ext)
    return F.when(low.isin(*MEDIA), F.when(is_music, F.lit("link")).otherwise(F.lit("strm"))).when(low.isin(*SIDECARS), F.lit("copy"))


def uniform(seed: int, draw: int, *keys: Column) -> Column:
    """A number in [0, 1) fixed by seed, draw and keys: 32 bits of an MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(str(draw)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
