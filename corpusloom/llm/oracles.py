"""DuckDB SQL for the contract queries that SQL can express.

The others are tested against brute force: op1 and op6 are models, op4, op5 and
op9 need a tokenizer, op8 a space-filling curve, and op10 a running entropy.
"""

from __future__ import annotations

from .quality_rules import MAX_REPEAT_PERCENT, MIN_WORDS, RULES, STOP_WORDS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"[^\x20\x09-\x0D]"


def _rule(r) -> str:
    return f"not (n_words >= {r.min_words} and 100 * {r.measure} {r.beyond} {r.bound} * {r.base})"


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
QUALITY = rf"""with w as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_SPACED}+') as ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_SPACED}')) as ls from documents),
 p as (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5),
 d as (select doc_id, i, count(*) over (partition by doc_id, list_slice(ws, i, i + 4)) as c from p),
 cov as (select doc_id, count(distinct i + k) as n from d, range(5) r(k) where c > 1 group by 1),
 m as (select w.doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words,
  len(regexp_extract_all(t, '[!?]')) as n_shouts, len(list_filter(ws, lambda x: list_contains([{_STOPS}], x))) as n_stop_words, len(ls) as n_lines from w left join cov on w.doc_id = cov.doc_id),
 b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from m)
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {' and '.join(map(_rule, RULES))} as kept from b"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
WINNOWING = f"""with d as (select doc_id, {_WORDS} as ws from documents), b as (select item_id, {_WORDS} as ws from benchmark where len({_WORDS}) > 0),
 w as (select distinct item_id, list_slice(ws, i, i + least(10, len(ws)) - 1) as win from (select item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) as i from b)),
 l as (select distinct len(win) as n from w),
 p as (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, l where len(ws) >= n),
 h as (select p.doc_id, p.i, p.n, w.item_id from p join w on list_slice(p.ws, p.i, p.i + p.n - 1) = w.win),
 c as (select doc_id, count(distinct i + k) as n_hit from h, range(10) r(k) where k < n group by 1),
 t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from h) group by 1)
 select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
 from d left join c using (doc_id) left join t using (doc_id)"""

JACCARD = rf"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SPACED}+') as ws from documents),
 s as (select distinct doc_id, list_slice(ws, i, i + 2) as g from (select doc_id, ws, unnest(range(1, greatest(1, len(ws) - 2) + 1)) as i from w where len(ws) > 0)),
 n as (select doc_id, count(*) as n from s group by 1),
 x as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
 e as (select a, b from x join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * i >= 90 * (na.n + nb.n - i)),
 r as (select doc_id as a, doc_id as b from w union select r.a, e.b from r join e on r.b = e.a)
 select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id from w left join n using (doc_id) join (select a, min(b) as component_id from r group by 1) c on c.a = w.doc_id"""

ORACLES: dict[str, str] = {"op2_jaccard_join": JACCARD, "op3_quality_rules": QUALITY, "op7_winnowing": WINNOWING}
