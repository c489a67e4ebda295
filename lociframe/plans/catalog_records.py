"""Registered queries: filters, sets, lookups, message rules, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.operators import filters, records, sets
from lociframe.plans.fixtures import view
from lociframe.plans.registry import Registry
from lociframe.operators.records import DAY, Rule, RuleSet

register = Registry()

_QTL = "select concat('rs',l_partkey) rsid, case when l_suppkey%3=0 then '6' when l_suppkey%3=1 then 'chr6' else '7' end chrom, 28400000 + l_orderkey*100 pos, case when l_linenumber%3=0 then -1 when l_linenumber%3=1 then 1 else 0 end sign, l_orderkey, l_linenumber from {lineitem}"


def qtl(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_QTL, lineitem=view(spark, sf, "lineitem"))


@register(
    "drop_region",
    f"select * from ({_QTL}) q where not (chrom in ('6','chr6') and pos>28477797 and pos<33448354)",
)
def drop_region(spark, sf):
    return filters.drop_region(qtl(spark, sf))


@register(
    "split_by_sign",
    f"select distinct rsid, 'open' side from ({_QTL}) q where sign=1 union all select distinct rsid, 'closed' from ({_QTL}) q where sign=-1",
)
def split_by_sign(spark, sf):
    opened, closed = filters.split_by_sign(qtl(spark, sf))
    return opened.withColumn("side", F.lit("open")).unionByName(closed.withColumn("side", F.lit("closed")))


@register("distinct_ids", f"select distinct rsid from ({_QTL}) q")
def distinct_ids(spark, sf):
    return filters.distinct_ids(qtl(spark, sf))


@register("maf_filter", "select chrom, pos, round(pre,9) pre, round(post,9) post from {fx_effects} where pre>0.02 and pre<0.98")
def maf_filter(spark, sf):
    kept = filters.maf_filter(view(spark, sf, "fx_effects"))
    return kept.select("chrom", "pos", F.round("pre", 9).alias("pre"), F.round("post", 9).alias("post"))


@register(
    "log_safe_pairs",
    """select l_orderkey, l_linenumber, round(log10(post),9) lx, round(log10(pre-0.5),9) ly from {fx_effects} where post>0 and pre-0.5>0""",
)
def log_safe_pairs(spark, sf):
    df = view(spark, sf, "fx_effects").withColumns({"x": F.col("post"), "y": F.col("pre") - 0.5})
    return filters.log_pairs(df).select("l_orderkey", "l_linenumber", F.round("lx", 9).alias("lx"), F.round("ly", 9).alias("ly"))


# The name map keeps two entries for each SNP, of which the later counts.
def _names(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "fx_snps")
    pairs = F.array(F.struct(F.lit(1).alias("ord"), F.lit("old").alias("name")), F.struct(F.lit(2).alias("ord"), F.col("name").alias("name")))
    return s.select(F.concat_ws(".", "chrom", "pos").alias("snp"), F.inline(pairs))


@register(
    "rename_lookup",
    """select concat(p.chrom,'.',p.pos) snp, p.p, s.name from {fx_points} p left join {fx_snps} s on p.chrom=s.chrom and p.pos=s.pos""",
)
def rename_lookup(spark, sf):
    points = view(spark, sf, "fx_points").select(F.concat_ws(".", "chrom", "pos").alias("snp"), "p")
    return sets.rename_lookup(points, _names(spark, sf))


_SIDE = "select set_id, perm, p_value from {fx_enrich} where sample='sample_%s'"


@register(
    "merge_two_samples",
    f"""select a.set_id, a.perm, round(a.p_value,9) sample_1_p_value, round(b.p_value,9) sample_2_p_value, round(log10(a.p_value),9) log10_sample_1_p_value,
          round(log10(b.p_value),9) log10_sample_2_p_value, round(abs(a.p_value-b.p_value),9) pdiff, round(abs(log10(a.p_value)-log10(b.p_value)),9) pldiff
        from ({_SIDE % 1}) a join ({_SIDE % 2}) b on a.set_id=b.set_id and a.perm=b.perm""",
)
def merge_two_samples(spark, sf):
    df = sets.merge_samples(view(spark, sf, "fx_enrich"), "sample_1", "sample_2", ["set_id", "perm"])
    return df.withColumns({c: F.round(c, 9) for c in df.columns if c not in ("set_id", "perm")})


@register(
    "join_suffixed",
    """select a.name, a.chrom chrom_snps, a.pos pos_snps, b.chrom chrom_parts, b.pos pos_parts, b.p_size from {fx_snps} a
       join (select concat('rs',p_partkey) name, concat('chr',p_size) chrom, p_partkey pos, p_size from {part}) b on a.name=b.name""",
)
def join_suffixed(spark, sf):
    a = view(spark, sf, "fx_snps").select("name", "chrom", "pos")
    b = view(spark, sf, "part").select(
        F.concat(F.lit("rs"), "p_partkey").alias("name"), F.concat(F.lit("chr"), "p_size").alias("chrom"), F.col("p_partkey").alias("pos"), "p_size"
    )
    return sets.join_suffixed(a, b, ["snps", "parts"], "name")


@register("merge_reads_sorted", """select id, chrom, pos1-1 "start", seq from {fx_reads}""")
def merge_reads_sorted(spark, sf):
    reads = view(spark, sf, "fx_reads").select("id", "chrom", (F.col("pos1") - 1).alias("start"), "seq", "flag")
    return sets.merge_reads(reads.where("flag = 0"), reads.where("flag = 16")).drop("flag")


_SETS = [
    "select concat('rs',l_orderkey) id from {lineitem} where l_returnflag='A'",
    "select concat('rs',l_orderkey) id from {lineitem} where l_returnflag='R'",
    "select concat('rs',l_orderkey) id from {lineitem} where l_returnflag='N'",
]


@register(
    "venn_counts",
    "select r region, count(*) ids from (select id, concat(max(a),max(b),max(c)) r from ("
    + " union all ".join(
        f"select id, {'1' if i == 0 else '0'} a, {'1' if i == 1 else '0'} b, {'1' if i == 2 else '0'} c from ({s}) s{i}" for i, s in enumerate(_SETS)
    )
    + ") x group by id) y group by 1",
)
def venn_counts(spark, sf):
    lineitem = view(spark, sf, "lineitem")
    return sets.venn([spark.sql(s, lineitem=lineitem) for s in _SETS])


@register(
    "concat_frames",
    "select name, chrom, pos, null::double p from {fx_snps} union all select null, chrom, pos, p from {fx_points}",
)
def concat_frames(spark, sf):
    return sets.concat_frames([view(spark, sf, "fx_snps").select("name", "chrom", "pos"), view(spark, sf, "fx_points")])


@register(
    "bulk_replace",
    """select doc_id, md5(regexp_replace(text, 't[hi]on?', '<>', 'g')) text_md5, regexp_matches(text, 't[hi]on?') changes from {documents}""",
)
def bulk_replace(spark, sf):
    docs = view(spark, sf, "documents")
    would = records.bulk_replace(docs, "t[hi]on?", "<>", dry_run=True).select("doc_id", F.lit(True).alias("changes"))
    done = records.bulk_replace(docs, "t[hi]on?", "<>").select("doc_id", F.md5("text").alias("text_md5"))
    return done.join(would, "doc_id", "left").withColumn("changes", F.coalesce("changes", F.lit(False)))


# ---- message rules ----

RULES = RuleSet(
    tagging=[
        Rule(listed=["listed"], flags=["Protected"]),
        Rule(subject=["medic", "aux"], flags=["sensitive"]),
        Rule(subject=["OUELLE"], recipients=["to3@"], folders=["Receipts", "archive"], flags=["\\Seen"]),
        Rule(header_is=[("x-encryption", "none")], folders=["unencrypted"]),
        Rule(header_exists=["list-unsubscribe"], folders=["Mail List", "archive"], flags=["\\Seen"], expire=60 * DAY),
        Rule(sender=["system"], flags=["Protected", "\\Flagged", "Retain"]),
    ],
    disposal=[
        Rule(subject=["the"], folders=["archive"], flags=["\\Seen"]),
        Rule(subject=["und"], folders=["trash"], expire=7 * DAY),
        Rule(subject=["eneu"], flags=["reject", "report", "junk"]),
    ],
    discard=Rule(subject=["paeux"]),
    spammers=Rule(recipients=["to5@"]),
    loop=Rule(subject=["quepa"]),
)


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Messages with headers from their text, some already reported; one role's people are contacts."""
    m = view(spark, sf, "fx_messages")
    headers = F.map_filter(
        F.create_map(
            F.lit("x-encryption"), F.when(F.contains("body", F.lit("ç")), "None").otherwise("tls"),
            F.lit("list-unsubscribe"), F.when(F.contains("body", F.lit("von")), "yes"),
        ),
        lambda k, v: v.isNotNull(),
    )
    m = m.withColumns(
        {
            "sender": F.concat_ws("@", "sender", F.expr("cast(pmod(msg_id div 1000, 9) as string)")),
            "headers": headers,
            "prior_flags": F.when(F.contains("body", F.lit("ron")), F.array(F.lit("reported"))).otherwise(F.array().cast("array<string>")),
        }
    )
    contacts = m.where(F.col("sender").isin("user@4", "assistant@4", "user@7")).select("sender").distinct()
    return records.mark_listed(m, contacts)


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    return records.apply_rules(messages(spark, sf), RULES)


_MSG = """
select *, contains(s,'medic') or contains(s,'aux') sens0, contains(s,'ouelle') or contains(recipients,'to3@') rec, contains(body,'ç') unenc, contains(body,'von') lst,
  contains(sender_,'system') vip, sender_ in ('user@4','assistant@4','user@7') contact, contains(s,'the') arch, contains(s,'und') trash, contains(s,'eneu') rej0,
  contains(s,'paeux') disc0, contains(recipients,'to5@') or spam_score>=8 spam0, spam_score>=3 junk0, contains(s,'quepa') loop0, contains(body,'ron') prior
from (select *, lower(subject) s, concat(sender,'@',(msg_id//1000)%9) sender_ from {fx_messages}) a"""
_TAGGED = f"""
select *, prot_ safe, not prot_ and spam0 spam, not prot_ and not spam0 and junk0 junk, not prot_ and rej0 reject, not prot_ and (spam0 or rej0) report,
  not prot_ and (spam0 or junk0 or rej0) junkflag
from (select *, contact or vip prot_ from ({_MSG}) m) m2"""
_FLAGS = """array_to_string(list_sort(list_distinct(list_filter([case when prior then 'reported' end, case when safe then 'Protected' end, case when sens0 then 'sensitive' end,
  case when rec or lst or (not safe and arch) or spam or junk then '\\Seen' end, case when vip then '\\Flagged' end, case when vip then 'Retain' end,
  case when reject then 'reject' end, case when report then 'report' end, case when junkflag then 'junk' end,
  case when report and not loop0 and not sens0 then 'reported' end], lambda v: v is not null))), ',')"""
_FOLDERS = """array_to_string(list_sort(list_distinct(list_filter([case when rec then 'Receipts' end, case when rec or lst or (not safe and arch) then 'archive' end,
  case when unenc then 'unencrypted' end, case when lst then 'Mail List' end, case when not safe and trash then 'trash' end, case when junkflag then 'spam' end,
  case when vip then 'inbox' end], lambda v: v is not null))), ',')"""
_EXPIRES = """case when safe or (report and sens0 and not loop0) then null when spam then 3600 when not safe and trash then 604800 when lst then 5184000 end"""


@register("rule_tagging", f"select msg_id, {_FLAGS} flags, {_FOLDERS} folders from ({_TAGGED}) t")
def rule_tagging(spark, sf):
    return tagged(spark, sf).select(
        "msg_id", F.array_join(F.array_sort("flags"), ",").alias("flags"), F.array_join(F.array_sort("folders"), ",").alias("folders")
    )


@register(
    "rule_precedence",
    f"""select msg_id, case when safe then 'keep' when report and loop0 then 'discard' when report and not sens0 and prior and disc0 then 'discard'
          when report and not sens0 and prior then 'file' when reject then 'reject' when report and sens0 then 'keep' when not safe and disc0 then 'discard'
          when {_FOLDERS}<>'' then 'file' else 'keep' end action from ({_TAGGED}) t""",
)
def rule_precedence(spark, sf):
    return tagged(spark, sf).select("msg_id", "action")


@register(
    "expiry_time",
    f"select msg_id, expires_in, strftime(ts + to_seconds(expires_in), '%Y-%m-%d %H:%M:%S') expires_at from (select msg_id, ts, cast({_EXPIRES} as double) expires_in from ({_TAGGED}) t) e",
)
def expiry_time(spark, sf):
    timed = records.expires_at(tagged(spark, sf))
    return timed.select(
        "msg_id", F.col("expires_in").cast("double").alias("expires_in"), F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at")
    )


@register(
    "manifest_diff",
    "select page_id, path, size, md5 from {fx_manifest} a where not exists (select 1 from {fx_manifest2} b where a.path=b.path and a.size=b.size and a.md5=b.md5)",
)
def manifest_diff(spark, sf):
    return records.manifest_diff(view(spark, sf, "fx_manifest"), view(spark, sf, "fx_manifest2"))


@register(
    "checksum_audit",
    "select b.path, case when a.md5=b.md5 then 'OK' else 'FAILED' end status from {fx_manifest2} b join {fx_manifest} a on a.path=b.path",
)
def checksum_audit(spark, sf):
    files = view(spark, sf, "pages").select(F.col("url").alias("path"), F.md5("html").alias("md5"))
    return records.checksum_audit(files, view(spark, sf, "fx_manifest2"))
