"""Tagging rules over messages, manifests, checksums, bulk replacement."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.plans.lookups import lookup

DAY, HOUR = 86400, 3600


@dataclass(frozen=True)
class Rule:
    """Matches when any of its conditions does; text conditions ignore case.

    ``listed`` names boolean columns, such as the ones ``mark_listed`` adds.
    """

    sender: Sequence[str] = ()
    subject: Sequence[str] = ()
    recipients: Sequence[str] = ()
    header_exists: Sequence[str] = ()
    header_is: Sequence[tuple[str, str]] = ()
    listed: Sequence[str] = ()
    folders: Sequence[str] = ()
    flags: Sequence[str] = ()
    expire: int | None = None

    def matches(self) -> Column:
        tests = [
            F.contains(F.lower(column), F.lit(word.lower()))
            for column, words in (("sender", self.sender), ("subject", self.subject), ("recipients", self.recipients))
            for word in words
        ]
        tests += [F.map_contains_key("headers", F.lit(h)) for h in self.header_exists]
        tests += [F.lower(F.element_at("headers", F.lit(h))) == v.lower() for h, v in self.header_is]
        tests += [F.col(c) for c in self.listed]
        return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(False))


@dataclass(frozen=True)
class RuleSet:
    """``tagging`` rules apply to every message. Those that end up Retain or Protected leave there;
    ``disposal`` rules, ``discard``, the spam tiers, ``loop`` and rejection see only the rest."""

    tagging: Sequence[Rule] = ()
    disposal: Sequence[Rule] = ()
    discard: Rule = field(default_factory=Rule)
    spammers: Rule = field(default_factory=Rule)
    loop: Rule = field(default_factory=Rule)
    # Scores of the two spam tiers, expiry of the upper one.
    spam_score: int = 8
    junk_score: int = 3
    spam_expiry: int = HOUR


def mark_listed(df: DataFrame, addresses: DataFrame, column: str = "listed", sender: str = "sender") -> DataFrame:
    """Adds a boolean: is the sender in the list. The list is broadcast if its size allows; beyond that frequent senders are not shuffled by name."""
    known = addresses.select(F.col(sender)).distinct().withColumn("_listed", F.lit(True))
    found = lookup(df, known, [sender], "left")
    return found.select(sender, *[c for c in df.columns if c != sender], F.coalesce("_listed", F.lit(False)).alias(column))


def _collect(rules: Sequence[tuple[Column, Sequence[str]]]) -> Column:
    empty = F.array().cast("array<string>")
    if not rules:
        return empty
    return F.array_distinct(
        F.flatten(F.array(*[F.when(hit, F.array(*[F.lit(v) for v in values])).otherwise(empty) if values else empty for hit, values in rules]))
    )


def apply_rules(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Adds folders, flags, action (keep, file, discard, reject) and expires_in (seconds or NULL).

    Every rule becomes a boolean column, so the state that the rules pass on is in plain columns
    and the whole set is one projection.
    """
    hits = {f"_t{i}": r.matches() for i, r in enumerate(rules.tagging)}
    hits |= {f"_d{i}": r.matches() for i, r in enumerate(rules.disposal)}
    hits |= {"_discard": rules.discard.matches(), "_spammer": rules.spammers.matches(), "_loop": rules.loop.matches()}
    out = df.withColumns(hits)
    if "prior_flags" not in df.columns:
        out = out.withColumn("prior_flags", F.array().cast("array<string>"))

    tag = [(F.col(f"_t{i}"), r) for i, r in enumerate(rules.tagging)]
    out = out.withColumn("_flags", F.array_union("prior_flags", _collect([(h, r.flags) for h, r in tag])))
    has = lambda flag: F.array_contains("_flags", flag)
    out = out.withColumns({"_retain": has("Retain"), "_safe": has("Retain") | has("Protected")})
    free = ~F.col("_safe")

    drop = [(F.col(f"_d{i}") & free, r) for i, r in enumerate(rules.disposal)]
    out = out.withColumn("_flags", F.array_union("_flags", _collect([(h, r.flags) for h, r in drop])))
    spam = free & (F.col("_spammer") | (F.col("spam_score") >= rules.spam_score))
    junk = free & ~spam & (F.col("spam_score") >= rules.junk_score)
    out = out.withColumns({"_spam": F.coalesce(spam, F.lit(False)), "_junk": F.coalesce(junk, F.lit(False))})
    out = out.withColumn(
        "_flags",
        F.array_union("_flags", _collect([(F.col("_spam"), ["\\Seen", "junk", "report"]), (F.col("_junk"), ["\\Seen", "junk"])])),
    )
    out = out.withColumns(
        {
            "_report": free & has("report"),
            "_sensitive": has("sensitive"),
            "_reported": has("reported"),
            "_reject": free & has("reject"),
            "_spamfolder": free & has("junk"),
        }
    )
    report, sensitive, loop = F.col("_report"), F.col("_sensitive"), F.col("_loop")
    news = report & ~loop & ~sensitive & ~F.col("_reported")
    folders = _collect(
        [(h, r.folders) for h, r in tag]
        + [(h, r.folders) for h, r in drop]
        + [(F.col("_spamfolder"), ["spam"]), (F.col("_retain"), ["inbox"])]
    )
    action = (
        F.when(F.col("_safe"), "keep")
        .when(report & loop, "discard")
        .when(report & ~sensitive & F.col("_reported") & F.col("_discard"), "discard")
        .when(report & ~sensitive & F.col("_reported"), "file")
        .when(F.col("_reject"), "reject")
        .when(report & sensitive, "keep")
        .when(F.col("_discard"), "discard")
        .when(F.size("folders") > 0, "file")
        .otherwise("keep")
    )
    # The last expiry set counts; keeping a message clears it.
    timed = [F.when(F.col("_spam"), rules.spam_expiry)]
    timed += [F.when(h, r.expire) for h, r in reversed(drop) if r.expire is not None]
    timed += [F.when(h, r.expire) for h, r in reversed(tag) if r.expire is not None]
    cleared = F.col("_safe") | (report & sensitive & ~loop)
    out = out.withColumns(
        {
            "folders": folders,
            "flags": F.array_union("_flags", _collect([(news, ["reported"])])),
            "expires_in": F.when(~cleared, F.coalesce(*timed)).cast("long"),
        }
    ).withColumn("action", action)
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def expires_at(tagged: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds the time a tagged message goes, NULL when it stays."""
    seconds = F.make_dt_interval(secs=F.col("expires_in").cast("decimal(18,6)"))
    return tagged.withColumn("expires_at", F.when(F.col("expires_in").isNotNull(), F.col(ts) + seconds))


def manifest_diff(source: DataFrame, target: DataFrame, on: Sequence[str] = ("path", "size", "md5")) -> DataFrame:
    """Entries of ``source`` that are new or changed against ``target``, folders first; empty when
    both are the same."""
    new = source.join(target.select(*on), list(on), "left_anti")
    return new.orderBy(~F.col("path").endswith("/"), "path")


def list_files(spark, path: str) -> DataFrame:
    """path, size, modified and md5 of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.md5("content").alias("md5"))


def parse_md5sums(lines: DataFrame) -> DataFrame:
    """``md5  path`` lines as a manifest."""
    pattern = r"^([0-9a-fA-F]{32}) [ *](.+)$"
    return lines.where(F.col("value").rlike(pattern)).select(
        F.regexp_extract("value", pattern, 2).alias("path"), F.lower(F.regexp_extract("value", pattern, 1)).alias("md5")
    )


def checksum_audit(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path and OK / FAILED for the files a manifest lists; files that are not there are left out."""
    return manifest.select("path", F.col("md5").alias("_want")).join(files.select("path", "md5"), "path").select(
        "path", F.when(F.lower("md5") == F.lower("_want"), "OK").otherwise("FAILED").alias("status")
    )


def bulk_replace(df: DataFrame, old: str, new: str, text: str = "text", dry_run: bool = False) -> DataFrame:
    """Replace every match of the pattern ``old``; ``dry_run`` only lists the rows that would change."""
    if dry_run:
        return df.where(F.col(text).rlike(old))
    return df.withColumn(text, F.regexp_replace(text, old, new))
