"""Queries of the corpus problems p6 to p8."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..session import bounded_batches, written
from . import bpe, langid, mixing

R = Registry()


def _documents(t):
    bounded_batches(t.spark)
    return t.documents


@R.query("p6_ids")
def _p6(t):
    return bpe.encode_corpus(_documents(t))


@R.query("p7_found")
def _p7(t):
    return mixing.found(_documents(t), t.mix_targets)


@R.query("p7_mix")
def _p7_mix(t):
    return mixing.place(written(mixing.sizes(_documents(t), t.mix_targets)), t.mix_targets)


@R.query("p7_report")
def _p7_report(t):
    return mixing.report(written(mixing.sizes(_documents(t), t.mix_targets)), t.mix_targets)


#: The same mixing with sizes in characters, which SQL has too.
_CHARS = 4096


@R.query(
    "p7_report_chars",
    f"""with m as (select mix, source, greatest(coalesce(max(target_share), 0), 0) as w, coalesce(max(max_repeat), 1)::bigint as r from mix_targets where mix is not null and source is not null group by 1, 2),
n as (select doc_id, source, n_chars as n from documents where source in (select source from m)), s as (select source, sum(n)::bigint as total from n group by 1),
d as (select m.*, coalesce(total, 0) as total, sum(coalesce(total, 0)) over (partition by mix) as size from m left join s using (source)),
o as (select source, n, (sum(n) over (partition by source order by (doc_id % 2147483648 * 2654435761) % 4294967296, doc_id) - n)::bigint as at from n where n > 0),
u as (select d.mix, d.source, o.n, o.at, unnest(generate_series(1, d.r)) as pass from d join o using (source) where d.w > 0),
g as (select u.mix, u.source, sum(u.n)::bigint as tokens, count(*) as uses from u join d on u.mix = d.mix and u.source = d.source where u.at + (pass - 1) * d.total < d.w * d.size group by 1, 2),
x as (select d.*, coalesce(tokens, 0) as tokens, coalesce(uses, 0) as uses from d left join g using (mix, source))
select mix, source, w as target_share, round(case when size > 0 then tokens / size else 0 end, 9) as actual_share, round(tokens / nullif(sum(tokens) over (partition by mix), 0), 9) as output_share, tokens, uses,
greatest(ceil(w * size / {_CHARS}) - ceil(tokens / {_CHARS}), 0)::bigint as missed_blocks, w > 0 and (total = 0 or tokens < w * size) as short from x""",
)
def _p7_report_chars(t):
    n = written(t.documents.join(t.mix_targets.select("source").distinct(), "source", "left_semi").select("doc_id", "source", F.col("n_chars").alias("n_tokens")))
    x = mixing.report(n, t.mix_targets, block=_CHARS, frame=64)
    return x.withColumns({c: F.round(c, 9) for c in ("actual_share", "output_share")})


@R.query("p8_found")
def _p8(t):
    return langid.found(_documents(t), t.lang_samples)


@R.query("p8_labels")
def _p8_labels(t):
    return langid.label_documents(_documents(t), t.lang_samples)
