"""Queries of the operators for training data."""

from __future__ import annotations

import os

from skein.common import table
from skein.llm import bpe, broken, contamination, docpairs, langid, provenance, secrets, termfreq

#: Where the vocabulary files of public tokenizers are.
TOKENIZERS = os.environ.get("SKEIN_TOKENIZERS", "/opt/tokenizers")


def p1_found(spark, d):
    return provenance.classify(table(spark, d, "files")).select("file_id")


def p1_kinds(spark, d):
    return provenance.classify(table(spark, d, "files"))


def p2_found(spark, d):
    return docpairs.pairs(table(spark, d, "files")).select("file_id", "name", "line")


def p2_pairs(spark, d):
    return docpairs.pairs(table(spark, d, "files"))


def p3_found(spark, d):
    return secrets.find_secrets(table(spark, d, "entities"), table(spark, d, "relationships")).select("tab", "row_id", "field", "pos")


def p3_redacted(spark, d):
    return secrets.find_secrets(table(spark, d, "entities"), table(spark, d, "relationships"))


def p5_found(spark, d):
    return termfreq.frequencies(table(spark, d, "entities"), "ent_id", ["imports", "literals", "calls"])


def p6_found(spark, d):
    return broken.checked(table(spark, d, "files")).filter("broken").select("file_id").distinct()


def p6_rates(spark, d):
    return broken.rates(table(spark, d, "files"))


def p7_ids(spark, d):
    return bpe.encode(table(spark, d, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def p8_found(spark, d):
    return contamination.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark, d):
    return langid.languages(table(spark, d, "documents")).filter("is_case").select("doc_id", "block_no", "lang")


def p9_languages(spark, d):
    return langid.languages(table(spark, d, "documents")).drop("is_case")


QUERIES = {"p9_found": p9_found, "p9_languages": p9_languages, "p8_found": p8_found, "p1_found": p1_found, "p1_kinds": p1_kinds, "p2_found": p2_found, "p2_pairs": p2_pairs, "p5_found": p5_found, "p6_found": p6_found, "p6_rates": p6_rates, "p7_ids": p7_ids, "p3_found": p3_found, "p3_redacted": p3_redacted}
ORACLE: dict[str, str] = {
    "p5_found": """
with once as (select ent_id, arg_max(imports, loaded_at) as imports, arg_max(literals, loaded_at) as literals, arg_max(calls, loaded_at) as calls
              from entities group by ent_id),
v as (select ent_id, 'imports' as field, unnest(imports) as x from once
      union all select ent_id, 'literals', unnest(literals) from once
      union all select ent_id, 'calls', unnest(calls) from once),
t as (select ent_id, field, trim(x, chr(32) || chr(9) || chr(10)) as term from v),
ok as (select * from t where term <> ''),
tot as (select field, count(distinct ent_id) as n from ok group by field),
c as (select field, term, count(*) as n_occ, count(distinct ent_id) as n_records from ok group by field, term)
select c.field, term, n_occ, n_records,
  case when n_records > 0.01 * n then 'common' when n_records < 3 then 'rare' else 'ok' end as mark
from c join tot on c.field = tot.field""",
}
