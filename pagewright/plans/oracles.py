"""DuckDB SQL with the results of the registered queries."""

from __future__ import annotations

from pagewright.plans import catalog, inputs

#: Fixed values, written out again so that a slip in the engine's own tables shows.
LATIN = "af az bs ca cs cy da de en es et eu fi fr ga gl hr hu id is it jv ku la lb lt lv mi ms mt nl no oc pi pl pt qu rm ro sk sl sq sr-latn sv sw tl tr uz vi".split()
CYRILLIC, CJK, KOREAN = ["be", "ru", "uk"], ["ja", "zh"], ["ko"]
SUPPORTED = LATIN + CYRILLIC + CJK + KOREAN
ALIAS = {
    "bel": "be", "cat": "ca", "ces": "cs", "cze": "cs", "dan": "da", "deu": "de", "ger": "de", "german": "de",
    "dut": "nl", "nld": "nl", "eng": "en", "est": "et", "eus": "eu", "baq": "eu", "fin": "fi", "fra": "fr", "fre": "fr",
    "french": "fr", "glg": "gl", "hrv": "hr", "hun": "hu", "ind": "id", "isl": "is", "ice": "is", "ita": "it",
    "jpn": "ja", "kor": "ko", "korean": "ko", "lav": "lv", "lit": "lt", "nno": "no", "nob": "no", "nor": "no",
    "pol": "pl", "por": "pt", "ron": "ro", "rum": "ro", "rus": "ru", "slk": "sk", "slo": "sk", "slv": "sl", "spa": "es",
    "sr-latn": "sr-latn", "rs-latin": "sr-latn", "swe": "sv", "tur": "tr", "ukr": "uk", "vie": "vi", "chi-sim": "zh",
    "chi-sim-vert": "zh", "zho": "zh",
}
ALIAS3 = {
    "ar": "ara", "ara": "ara", "ben": "ben", "bn": "ben", "bg": "bul", "bul": "bul", "ces": "ces", "cs": "ces",
    "cze": "ces", "da": "dan", "dan": "dan", "de": "deu", "deu": "deu", "ger": "deu", "el": "ell", "ell": "ell",
    "gre": "ell", "en": "eng", "eng": "eng", "est": "est", "et": "est", "fa": "fas", "fas": "fas", "per": "fas",
    "fi": "fin", "fin": "fin", "fr": "fra", "fra": "fra", "fre": "fra", "he": "heb", "heb": "heb", "hi": "hin",
    "hin": "hin", "hr": "hrv", "hrv": "hrv", "hu": "hun", "hun": "hun", "id": "ind", "ind": "ind", "it": "ita",
    "ita": "ita", "ja": "jpn", "jpn": "jpn", "ko": "kor", "kor": "kor", "lav": "lav", "lv": "lav", "lit": "lit",
    "lt": "lit", "may": "msa", "ms": "msa", "msa": "msa", "dut": "nld", "nl": "nld", "nld": "nld", "no": "nor",
    "nor": "nor", "pl": "pol", "pol": "pol", "por": "por", "pt": "por", "ro": "ron", "ron": "ron", "rum": "ron",
    "ru": "rus", "rus": "rus", "sk": "slk", "slk": "slk", "slo": "slk", "sl": "slv", "slv": "slv", "es": "spa",
    "spa": "spa", "sr": "srp", "srp": "srp", "sv": "swe", "swe": "swe", "ta": "tam", "tam": "tam", "te": "tel",
    "tel": "tel", "th": "tha", "tha": "tha", "tr": "tur", "tur": "tur", "uk": "ukr", "ukr": "ukr", "vi": "vie",
    "vie": "vie",
}
WHOLE3 = {
    "zh-hans": "chi_sim", "zh_cn": "chi_sim", "zh-cn": "chi_sim", "zh-hant": "chi_tra", "zh_tw": "chi_tra",
    "zh-tw": "chi_tra",
}
MODELS = [
    ("v6-tiny-det", 1780590), ("v5-mobile-det", 4826518), ("v6-small-det", 9880512), ("v6-medium-det", 62032837), ("v6-tiny-rec", 4462639),
    ("v6-small-rec", 21159378), ("v6-medium-rec", 76554979), ("v5-eslav-rec", 7887627), ("v5-latin-rec", 8042023), ("v5-korean-rec", 13418787),
]
PROFILES = [
    ("fast", "v6-tiny-det", "v6-tiny-rec", 960), ("balanced", "v6-small-det", "v6-small-rec", 1280), ("accurate", "v6-small-det", "v6-small-rec", 1600),
    ("maximum", "v6-medium-det", "v6-medium-rec", 2048),
]


LINES = inputs.LINES
ORDERED = f"""
base as ({LINES}),
gaps as (select *, case when abs((y + height / 2) - lag(y + height / 2) over d) <= 0.5 * least(height, lag(height) over d)
                   then 0 else 1 end as brk from base window d as (partition by image_id order by y, x, position)),
rows_ as (select *, sum(brk) over (partition by image_id order by y, x, position rows unbounded preceding) as row_ from gaps),
ordered as (select *, row_number() over (partition by image_id order by row_, x, y, position) - 1 as ord from rows_)
"""
TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _values(rows: list[tuple], columns: str) -> str:
    text = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)
    return f"select * from (values {body}) as t({columns})"


def _pairs(table: dict[str, str], name: str) -> str:
    return f"{name} as ({_values(list(table.items()), 'k, v')})"


QUAD = """
q as (select line_id, width as w, height as h, x as x0, y as y0, x + width as x1, y + 3 as y1, x + width + 5 as x2, y + height + 3 as y2,
      x + 5 as x3, y + height as y3 from base),
g as (select *, (sqrt((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0)) + sqrt((x2-x3)*(x2-x3) + (y2-y3)*(y2-y3))) / 2 as gw,
      (sqrt((x3-x0)*(x3-x0) + (y3-y0)*(y3-y0)) + sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1))) / 2 as gh from q)
"""

SIZES = "list_value({})".format(", ".join(str(p[3]) for p in PROFILES))
TILES = f"""
with p as (select p_partkey, (p_partkey * 37) % 6000 + 100 as len, {SIZES}[p_partkey % 4 + 1] as tile from part),
s as (select *, len - tile as span, greatest(tile - greatest(tile // 8, 1), 1) as stride from p),
n as (select *, case when len <= tile then 0 else (span + stride - 1) // stride end as steps from s),
e as (select *, unnest(range(0, steps + 1)) as i from n)
select p_partkey, i as tile_no, case when steps = 0 then 0 else span * i // steps end as tile_start from e
"""

#: Fixed letters of the scripts, for RE2.
LETTERS = {"latin": r"[A-Za-z\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}]", "cyrillic": r"[\x{0400}-\x{052F}]", "korean": r"[\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7AF}]"}


def _share(column: str, script: str) -> str:
    letters = rf"length(regexp_replace({column}, '[^\p{{L}}]', '', 'g'))"
    own = rf"(length({column}) - length(regexp_replace(regexp_replace({column}, '[^\p{{L}}]', '', 'g'), '{LETTERS[script]}', '', 'g')) - (length({column}) - {letters}))"
    return f"(case when {letters} = 0 then 0.0 else cast({own} as double) / {letters} end)"


TAG = (
    r"case when regexp_matches({0}, '[\x{{0400}}-\x{{052F}}]') then 'Cyrl' "
    r"when regexp_matches({0}, '[\x{{1100}}-\x{{11FF}}\x{{3130}}-\x{{318F}}\x{{AC00}}-\x{{D7AF}}]') then 'Kore' "
    r"when regexp_matches({0}, '[\x{{3040}}-\x{{30FF}}]') then 'Jpan' when regexp_matches({0}, '[\x{{3400}}-\x{{9FFF}}]') then 'Hani' "
    r"when regexp_matches({0}, '\p{{L}}') then 'Latn' end"
)
HAS = {
    "latin": rf"regexp_matches(text, '{LETTERS['latin']}')",
    "cyrillic": rf"regexp_matches(text, '{LETTERS['cyrillic']}')",
    "korean": rf"regexp_matches(text, '{LETTERS['korean']}')",
}
CANDIDATES = f"""
recognizers as ({inputs.RECOGNIZERS}), words as ({inputs.WORDS}), candidates as ({inputs.CANDIDATES}),
shares as (select *, case recognizer when 'latin' then {_share('text', 'latin')} when 'cyrillic' then {_share('text', 'cyrillic')}
           when 'korean' then {_share('text', 'korean')} end as f from candidates where confidence >= 0.8),
ranked as (select *, row_number() over (partition by image_id, box_idx order by
           case when f is null then confidence when f > 0 then confidence + 0.004 * f * f else confidence - 0.08 end desc, confidence desc,
           case recognizer when 'latin' then 1 when 'cyrillic' then 2 when 'korean' then 3 else 0 end, encode(text)) as place from shares)
"""

TSV = r"""
w as (select doc_id, list_filter(string_split_regex(text, '\s+'), lambda s: s <> '') as ws from documents),
e as (select doc_id, unnest(ws) as word, unnest(range(0, len(ws))) as i from w),
kept as (select doc_id as image_id, i, i + 3 as position, word as text, cast((i * 37 + doc_id) % 101 as double) / 100 as confidence,
         i // 100 as blk, i // 10 as ln, cast((i % 10) * 60 as double) as l, cast(i // 10 * 20 as double) as t,
         cast(length(word) * 8 as double) as wd from e where cast((i * 37 + doc_id) % 101 as double) / 100 >= 0.5)
"""

POSTERIORS = """
p as (select vec_id as item, unnest(embedding)::double as score, unnest(range(0, len(embedding))) as nth from embeddings),
best as (select item, nth // 4 as step, max(score) as score, arg_max(nth % 4, (score, nth)) as token from p group by item, nth // 4),
lagged as (select *, lag(token, 1, -1) over (partition by item order by step) as prev from best),
kept as (select item, step, token, least(1, greatest(0, score)) as score from lagged where token <> 0 and token <> prev)
"""

WORD_BOXES = r"""
with t as (select item_id, text, length(text) as n, regexp_extract_all(text, '\S+') as ws, string_split_regex(text, '\S+') as gaps from benchmark),
e as (select item_id, n, unnest(range(0, len(ws))) as k, ws, gaps from t),
s as (select item_id, n, k, list_sum(list_transform(gaps[1:k + 1], lambda g: length(g))) + coalesce(list_sum(list_transform(ws[1:k], lambda g: length(g))), 0) as first_,
      length(ws[k + 1]) as len_ from e),
f as (select *, first_ + len_ - 1 as last_ from s),
b as (select *, case when first_ = 0 then 0.0 else ((first_ - 0.5) / (n + 2) + (first_ + 0.5) / (n + 2)) / 2 end as l,
      case when last_ = n - 1 then 1.0 else ((last_ + 0.5) / (n + 2) + (last_ + 1.5) / (n + 2)) / 2 end as r from f)
select item_id, k as word_no, round(10 + n * 8.0 * l, 6) as x0, round(10 + n * 8.0 * r, 6) as x1 from b
"""

TURNS = """
p as (select *, lead(text) over (partition by conv_id order by turn, text) as next from conversations),
pairs as (select * from p where next is not null and text is not null)
"""
#: levenshtein counts bytes here: each pair's characters outside ASCII become ASCII characters that the pair does not hold.
LETTERS_OF_PAIR = f"""
{TURNS},
seen as (select *, list_distinct(regexp_extract_all(concat(text, next), '(?s)[^\\x00-\\x7F]')) as wide,
         list_filter(list_transform(range(1, 128), lambda i: chr(i::int)), lambda c: not contains(concat(text, next), c)) as free from pairs),
spelled as (select conv_id, turn, text, next, translate(text, array_to_string(wide, ''), array_to_string(free[1:len(wide)], '')) as a,
            translate(next, array_to_string(wide, ''), array_to_string(free[1:len(wide)], '')) as b from seen)
"""

OVERLAP = f"""
with recursive base as ({LINES}),
a as (select image_id, position, x, y, width, height, row_number() over (partition by image_id order by width * height desc, position) as k from base),
f as (
  select image_id, k, [{{'x': x, 'y': y, 'w': width, 'h': height, 'p': position}}] as kept from a where k = 1
  union all
  select a.image_id, a.k, case when len(list_filter(f.kept, lambda s:
      greatest(least(s.x + s.w, a.x + a.width) - greatest(s.x, a.x), 0) * greatest(least(s.y + s.h, a.y + a.height) - greatest(s.y, a.y), 0)
      / least(s.w * s.h, a.width * a.height) >= 0.65)) > 0 then f.kept
    else list_append(f.kept, {{'x': a.x, 'y': a.y, 'w': a.width, 'h': a.height, 'p': a.position}}) end
  from f join a on a.image_id = f.image_id and a.k = f.k + 1
),
done as (select image_id, arg_max(kept, k) as kept from f group by image_id)
select image_id, unnest(list_transform(kept, lambda s: s.p)) as position from done
"""

WIDTHS = f"""
with recursive base as ({LINES}),
c as (select image_id, line_id as box_idx, cast(ceil(width * 48 / height) as bigint) as width,
      row_number() over (partition by image_id order by ceil(width * 48 / height), line_id) as k from base),
f as (
  select image_id, k, box_idx, width, 0::bigint as batch, 1 as n, width as widest from c where k = 1
  union all
  select c.image_id, c.k, c.box_idx, c.width,
    case when z.close_ then f.batch + 1 else f.batch end, case when z.close_ then 1 else f.n + 1 end,
    case when z.close_ then c.width else greatest(f.widest, c.width) end
  from f join c on c.image_id = f.image_id and c.k = f.k + 1,
  lateral (select f.n + 1 > 8 or greatest(f.widest, c.width) * (f.n + 1) > 8192 or (f.n >= 2 and c.width > greatest(256, f.widest * 1.85)) as close_) z
)
select image_id, box_idx, width, batch from f
"""

MATCHES = f"""
with recursive base as ({LINES}),
r as (select image_id, line_id as idx, x, y, width as w, height as h, row_number() over (partition by image_id order by line_id) as k from base),
m as (select image_id, list({{'i': line_id, 'x': x + line_id % 29, 'y': y, 'w': width, 'h': height}} order by line_id) as preds
      from base where line_id % 9 <> 0 group by image_id),
f as (
  select r.image_id, 0::bigint as k, null::bigint as ref, null::bigint as hit, []::bigint[] as used from r where k = 1
  union all
  select r.image_id, r.k, r.idx, z.hit, case when z.hit is null then f.used else list_append(f.used, z.hit) end
  from f join r on r.image_id = f.image_id and r.k = f.k + 1 join m on m.image_id = r.image_id,
  lateral (select list_sort(list_filter(list_transform(list_filter(m.preds, lambda p: not list_contains(f.used, p.i)), lambda p: {{
      'o': greatest(least(p.x + p.w, r.x + r.w) - greatest(p.x, r.x), 0) * greatest(least(p.y + p.h, r.y + r.h) - greatest(p.y, r.y), 0)
         / (p.w * p.h + r.w * r.h - greatest(least(p.x + p.w, r.x + r.w) - greatest(p.x, r.x), 0) * greatest(least(p.y + p.h, r.y + r.h) - greatest(p.y, r.y), 0)),
      'i': -p.i}}), lambda p: p.o >= 0.5), 'DESC')[1].i * -1 as hit) z
),
matched as (select image_id, ref as ref_idx, hit as pred_idx from f where hit is not null)
"""

#: Pages are turned as a whole, so that areas are those of the boxes before the turn.
_SHARE = "greatest(least({0}.x + {0}.w, {1}.x + {1}.w) - greatest({0}.x, {1}.x), 0) * greatest(least({0}.y + {0}.h, {1}.y + {1}.h) - greatest({0}.y, {1}.y), 0)"
_FOLDED = "replace(lower(regexp_replace({}, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')), 'ß', 'ss')"
TURNED = f"""
with recursive base as ({LINES}),
regions as (select image_id, line_id as i, x, y, width as w, height as h, text from base),
masks as (select * from regions where i % 10 = 4),
refs as (select *, row_number() over (partition by image_id order by i) as k from regions where i % 10 <> 4 and coalesce(text, '') <> '###'),
shown as (select image_id, i, x + i % 29 as x, y, w, h, case when i % 4 = 0 then concat('"', upper(text), '!)') when i % 5 = 0 then concat(text, ' x') else text end as text from regions where i % 9 <> 0),
preds as (select * from shown where not exists (select 1 from masks where masks.image_id = shown.image_id and {_SHARE.format('masks', 'shown')} > 0.5 * shown.w * shown.h)),
pairs as (select r.image_id, r.k, r.i as ref, p.i as hit, {_SHARE.format('r', 'p')} / (r.w * r.h + p.w * p.h - {_SHARE.format('r', 'p')}) as iou,
          coalesce({_FOLDED.format('r.text')} = {_FOLDED.format('p.text')}, false) as same_text from refs r join preds p on p.image_id = r.image_id and {_SHARE.format('r', 'p')} > 0),
near as (select image_id, k, list({{'o': iou, 'm': -hit}} order by iou desc, hit) as ps from pairs where iou >= 0.5 group by image_id, k),
f as (
  select image_id, 0::bigint as k, null::bigint as hit, []::bigint[] as used from (select distinct image_id from regions)
  union all
  select f.image_id, r.k, z.hit, case when z.hit is null then f.used else list_append(f.used, z.hit) end
  from f join refs r on r.image_id = f.image_id and r.k = f.k + 1 left join near on near.image_id = r.image_id and near.k = r.k,
  lateral (select -(list_filter(near.ps, lambda p: not list_contains(f.used, -p.m))[1].m) as hit) z
),
matched as (select f.image_id, ref as ref_idx, f.hit as pred_idx, round(iou, 6) as iou, same_text from f join pairs on pairs.image_id = f.image_id and pairs.k = f.k and pairs.hit = f.hit)
"""

RECOGNIZED = f"""
with recursive lines as ({LINES}), recognizers as ({inputs.RECOGNIZERS}), words as ({inputs.WORDS}), read as ({inputs.CANDIDATES}),
images as ({inputs.IMAGES}), seen as ({inputs.DETECTIONS}), twice as ({inputs.TWICE}),
placed as (select image_id, position, cast(tile_no as bigint) * 4294967296 + position as box, x, y + 860 * tile_no as y, width as w, height as h from twice),
sized as (select *, row_number() over (partition by image_id order by w * h desc, box) as k from placed where image_id % 2 = 0),
fold as (
  select image_id, k, [{{'x': x, 'y': y, 'w': w, 'h': h, 'b': box}}] as kept from sized where k = 1
  union all
  select s.image_id, s.k, case when len(list_filter(fold.kept, lambda p:
      greatest(least(p.x + p.w, s.x + s.w) - greatest(p.x, s.x), 0) * greatest(least(p.y + p.h, s.y + s.h) - greatest(p.y, s.y), 0) / least(p.w * p.h, s.w * s.h) >= 0.65)) > 0
    then fold.kept else list_append(fold.kept, {{'x': s.x, 'y': s.y, 'w': s.w, 'h': s.h, 'b': s.box}}) end
  from fold join sized s on s.image_id = fold.image_id and s.k = fold.k + 1
),
stay as (select image_id, unnest(list_transform(kept, lambda p: p.b)) as box from (select image_id, arg_max(kept, k) as kept from fold group by image_id)),
boxes as (select * from placed where image_id % 7 <> 6 and (image_id % 2 = 1 or exists (select 1 from stay where stay.image_id = placed.image_id and stay.box = placed.box))),
r as (select b.image_id, b.box, b.x, b.y, b.w, b.h, recognizer, text, confidence from boxes b join read on read.image_id = b.image_id and read.box_idx = b.position where trim(text) <> ''),
prime as (select *, case image_id % 4 when 0 then 'primary' when 1 then 'latin' when 2 then 'primary' end as main from boxes),
heard as (select p.*, r.text as said, r.confidence as sure from prime p left join r on r.image_id = p.image_id and r.box = p.box and r.recognizer = p.main),
asked as (
  select image_id, box, w, h, main as recognizer, 'primary' as role from heard where main is not null
  union all select image_id, box, w, h, 'latin', 'latin' from heard where image_id % 4 = 0 and (sure is null or sure < 0.99 or {HAS['latin'].replace('text', 'said')})
  union all select image_id, box, w, h, 'cyrillic', 'cyrillic' from heard where image_id % 4 = 0 and (sure is null or sure < 0.99 or {HAS['cyrillic'].replace('text', 'said')})
  union all select image_id, box, w, h, 'korean', 'korean' from heard where image_id % 4 = 0 and (sure is null or sure < 0.99 or {HAS['korean'].replace('text', 'said')})
  union all select image_id, box, w, h, 'cyrillic', 'cyrillic' from heard where image_id % 4 = 2 and (sure is null or sure < 0.82 or {HAS['cyrillic'].replace('text', 'said')})
  union all select image_id, box, w, h, 'korean', 'korean' from heard where image_id % 4 = 3),
chunked as (select *, (row_number() over (partition by image_id, recognizer order by w / h, box) - 1) // 8 as batch from asked),
batched as (select *, greatest(1, max(w / h) over (partition by image_id, recognizer, batch)) as most from chunked),
cands as (select a.*, r.text, r.confidence, r.x, r.y, case role when 'latin' then {_share('text', 'latin')} when 'cyrillic' then {_share('text', 'cyrillic')} when 'korean' then {_share('text', 'korean')} end as f
          from batched a join r using (image_id, box, recognizer) where r.confidence >= 0.8),
placed_ as (select *, row_number() over (partition by image_id, box order by case when f is null then confidence when f > 0 then confidence + 0.004 * f * f else confidence - 0.08 end desc,
            confidence desc, case role when 'latin' then 1 when 'cyrillic' then 2 when 'korean' then 3 else 0 end, encode(text)) as place from cands),
won as (select *, row_number() over (partition by image_id order by box) as number,
        (select count(distinct o.text) from placed_ o where o.image_id = p.image_id and o.box = p.box and o.text <> p.text) as n_alternatives from placed_ p where place = 1),
inside as (select won.*, least(won.x, 1200) as x0, least(won.x + won.w, 1200) as x1, least(won.y, height) as y0, least(won.y + won.h, height) as y1,
           list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '') as toks from won join images using (image_id)),
share as (select *, length(toks[1]) as n1, length(text) as n, (w / h) * (length(text) + 2) / most as s from inside),
shown as (select *, case when n1 = n then 1.0 else (least(1, (n1 - 0.5) / s) + least(1, (n1 + 0.5) / s)) / 2 end as cut_ from share),
gaps as (select *, case when abs((y0 + y1) / 2 - lag((y0 + y1) / 2) over d) <= 0.5 * least(y1 - y0, lag(y1 - y0) over d) then 0 else 1 end as brk from shown window d as (partition by image_id order by y0, x0, number)),
rows_ as (select *, sum(brk) over (partition by image_id order by y0, x0, number rows unbounded preceding) as row_ from gaps),
final as (select *, row_number() over (partition by image_id order by row_, x0, y0, number) - 1 as ord, {TAG.format('text')} as tag from rows_)
"""

REQUESTS = "kinds as (select * from (values {}) as t(kind, request)), requests as (select doc_id as request_id, request from documents join kinds on kind = doc_id % {})".format(
    ", ".join(f"({i}, {r!r}::varchar[])" for i, r in catalog.REQUESTS), len(catalog.REQUESTS)
)


def _list(codes: list[str]) -> str:
    return "[" + ", ".join(f"'{c}'" for c in codes) + "]"


PLANS = f"""
{REQUESTS}, {_pairs(ALIAS, 'alias')},
words_ as (select request_id, unnest(request) as raw, unnest(range(0, len(request))) as i, len(request) as n from requests),
clean as (select *, replace(lower(trim(raw)), '_', '-') as s from words_),
coded as (select request_id, i, n, raw, coalesce(a.v, split_part(s, '-', 1)) as code from clean left join alias a on s = a.k
          where not (n = 1 and lower(trim(raw)) = 'auto')),
agg as (select request_id, list(code) as codes, string_agg(case when not list_contains({_list(SUPPORTED)}, code) then raw end, ',' order by i) as bad
        from coded group by request_id),
flags as (select r.request_id, coalesce(len(codes), 0) = 0 as auto, coalesce(bad, '') as unsupported,
  coalesce(list_has_any(codes, {_list(LATIN)}), false) as lg, coalesce(list_has_any(codes, {_list(CYRILLIC)}), false) as cy,
  coalesce(list_has_any(codes, {_list(CJK)}), false) as cj, coalesce(list_has_any(codes, {_list(KOREAN)}), false) as ko,
  coalesce(list_has_any(codes, {_list([c for c in LATIN if c != 'en'])}), false) as la from requests r left join agg using (request_id)),
plans as (select request_id, auto or cj or (lg::int + cy::int + cj::int + ko::int > 1) or (lg and not la) as "primary", auto or la as latin,
  auto or cy as cyrillic, auto or ko as korean, unsupported from flags)
"""
MODEL_ROWS = f"models as ({_values(MODELS, 'model, bytes')})"

CODES = f"""
with {_pairs(ALIAS, 'alias')}, {_pairs(ALIAS3, 'alias3')}, {_pairs(WHOLE3, 'whole3')},
raws as (select distinct lang as raw from documents where lang is not null union {_values([(s,) for s in catalog.SPELLINGS], 'raw')}),
c as (select raw, lower(trim(raw)) as s, replace(lower(trim(raw)), '_', '-') as d from raws)
select raw, coalesce(a.v, split_part(d, '-', 1)) as code, list_contains({_list(SUPPORTED)}, coalesce(a.v, split_part(d, '-', 1))) as supported,
       coalesce(w.v, b.v, s) as code3
from c left join alias a on d = a.k left join whole3 w on s = w.k left join alias3 b on regexp_extract(s, '^[^-_]*') = b.k
"""

VALID = f"""
with {ORDERED},
p as (select *, case when line_id % 17 = 0 then 0 else ord end as o from ordered),
d as (select *, row_number() over (partition by image_id, o order by position) > 1 as again from p),
a as (select image_id, count_if(again) as n_order, count_if(x + width > 1000 or y + height > 600) as n_outside, count_if(line_id % 13 = 0) as n_confidence,
      count_if(line_id % 19 = 0) as n_language from d group by image_id)
select image_id, n_order, n_outside, n_confidence, n_language, case when image_id % 3 = 0 then 1 else 0 end as n_sha, 1 as n_tags,
       n_order + n_outside + n_confidence + n_language + case when image_id % 3 = 0 then 1 else 0 end + 1 as n_errors from a
"""

#: A row of the edit distance table a step: the row above is `prev`; one-element lists carry the column numbers.
WORD_ERRORS = f"""
with recursive {TURNS},
k as (select conv_id, turn, list_filter(string_split_regex(text, '[\\t\\n\\v\\f\\r\\x{{85}}\\p{{Z}}]+'), lambda w: w <> '') as a,
      list_filter(string_split_regex(next, '[\\t\\n\\v\\f\\r\\x{{85}}\\p{{Z}}]+'), lambda w: w <> '') as b from pairs),
f as (
  select conv_id, turn, a, b, 0::bigint as i, range(0, len(b) + 1) as prev from k
  union all
  select conv_id, turn, a, b, i + 1, list_reduce(list_transform(range(1, len(b) + 1), lambda j: [j]),
    lambda acc, y: list_append(acc, least(prev[y[1] + 1] + 1, acc[len(acc)] + 1, prev[y[1]] + case when a[i + 1] = b[y[1]] then 0 else 1 end)), [i + 1])
  from f where i < len(a)
),
e as (select conv_id, turn, len(a) as n, prev[len(prev)] as edits from f where i = len(a))
select conv_id, turn, edits, n as reference_units, round(case when n > 0 then edits / n when edits > 0 then 1 else 0 end, 6) as rate from e
"""

REGIONS = """
with p as (select p_partkey as image_id, (p_partkey * 7) % 20 + 11.5 as cx, 12.5 as cy, 2 * 23 * 9 * 1.4 / (2 * (23 + 9)) as grow from part),
e as (select image_id, greatest(0, floor((cx - (23 + grow) / 2) * 10 + 0.5)) as l, least(640, floor((cx + (23 + grow) / 2) * 10 + 0.5)) as r,
      greatest(0, floor((cy - (9 + grow) / 2) * 10 + 0.5)) as t, least(320, floor((cy + (9 + grow) / 2) * 10 + 0.5)) as b from p)
select image_id, 0 as position, cast(l as double) as x, cast(t as double) as y, cast(r - l as double) as width, cast(b - t as double) as height, 0.93::double as score from e
"""

WORDED = f"words as ({inputs.WORDS}), worded as (select doc_id, word, concat_ws(' ', word, text) as text from documents join words on n = doc_id % {len(inputs.TEXTS)})"

ORACLES = {
    "word_errors": WORD_ERRORS,
    "heatmap_regions": REGIONS,
    "reading_order": f"with {ORDERED} select image_id, line_id, cast(row_ as bigint) as row, ord as line_order from ordered",
    "rebuild_text": f"""with {ORDERED},
t as (select *, {TRIM.format('text')} as a, {TRIM.format('coalesce(corrected_text, text)')} as b from ordered),
j as (select image_id, coalesce(string_agg(case when not ignored and a <> '' then a end, chr(10) order by ord), '') as text,
      coalesce(string_agg(case when not ignored and b <> '' then b end, chr(10) order by ord), '') as fixed from t group by image_id)
select image_id, text, nullif(fixed, text) as corrected_text from j""",
    "line_bounds": f"""with base as ({LINES}), {QUAD}
select line_id, x0 as x, y0 as y, x2 - x0 as width, y2 - y0 as height,
       round(abs(x0*y1 - x1*y0 + x1*y2 - x2*y1 + x2*y3 - x3*y2 + x3*y0 - x0*y3) / 2, 6) as area from g""",
    "crop_geometry": f"""with base as ({LINES}), {QUAD}
select line_id, round(gw, 6) as width, round(gh, 6) as height, round((x0 + x1 + x2 + x3) / 4, 6) as cx, round((y0 + y1 + y2 + y3) / 4, 6) as cy,
       round(atan2(y1 - y0, x1 - x0), 6) as angle, round(gw * gh * 1.4 / (2 * (gw + gh)), 6) as delta,
       greatest(1, least(3200, cast(ceil(w * 48 / h) as bigint))) as rec_width from g""",
    "overlap_dedup": OVERLAP,
    "tile_offsets": TILES,
    "tiled_images": """with p as (select p_partkey, (p_partkey * 37) % 4000 + 100 as w, (p_partkey * 91) % 4000 + 100 as h from part)
select p_partkey, greatest(w, h) > 1920 and greatest(w, h) >= 2 * least(w, h) as tiled from p""",
    "crop_batches": f"""with base as ({LINES}),
b as (select image_id, line_id as box_idx, width / height as ratio, (row_number() over (partition by image_id order by width / height, line_id) - 1) // 8 as batch from base)
select image_id, box_idx, batch, round(greatest(1, max(ratio) over (partition by image_id, batch)), 6) as batch_max_ratio from b""",
    "width_batches": WIDTHS,
    "script_tags": f"""with words as ({inputs.WORDS}), t as (select text from documents union all select word from words)
select {TAG.format('text')} as tag, count(*) as n from t group by 1""",
    "script_fractions": f"with {WORDED} select doc_id, " + ", ".join(f"round({_share('text', k)}, 6) as {k}" for k in LETTERS) + " from worded",
    "language_codes": CODES,
    "recognizer_plans": f"with {PLANS} select * from plans",
    "required_models": f"""with {PLANS}, {MODEL_ROWS},
needed as (select request_id, unnest(['v6-small-det', case when "primary" then 'v6-small-rec' end, case when latin then 'v5-latin-rec' end,
  case when cyrillic then 'v5-eslav-rec' end, case when korean then 'v5-korean-rec' end]) as model from plans where unsupported = '')
select request_id, count(*) as models, cast(sum(bytes) as bigint) as bytes from needed join models using (model) group by request_id""",
    "line_languages": f"""with {WORDED}, t as (select doc_id, {TAG.format('word')} as tag from worded)
select doc_id, case tag when 'Kore' then 'ko' when 'Jpan' then 'ja' end as free,
       case tag when 'Cyrl' then 'ru' when 'Hani' then 'zh' when 'Latn' then 'de' end as hinted from t""",
    "select_candidate": f"with {CANDIDATES} select image_id, box_idx, recognizer, text, round(confidence, 6) as confidence from ranked where place = 1",
    "candidate_alternatives": f"""with {CANDIDATES},
firsts as (select *, row_number() over (partition by image_id, box_idx, text order by place) as nth, first_value(text) over (partition by image_id, box_idx order by place) as best from ranked)
select image_id, box_idx, coalesce(string_agg(case when nth = 1 and text <> best then text end, '|' order by place), '') as others from firsts group by 1, 2""",
    "route_crops": f"""with {CANDIDATES},
found as (select distinct image_id, box_idx from candidates),
prim as (select image_id, box_idx, text, confidence from candidates where recognizer = 'primary'),
j as (select f.image_id, f.box_idx, text, confidence, f.image_id % 2 <> 0 as auto, f.image_id % 3 <> 1 as "primary",
      f.image_id % 3 <> 2 as latin, f.image_id % 5 <> 2 as cyrillic, f.image_id % 5 <> 3 as korean from found f left join prim p using (image_id, box_idx)),
u as (
  select image_id, box_idx, 'latin' as specialist from j where latin and (not auto or confidence is null or confidence < 0.99 or {HAS['latin']})
  union all
  select image_id, box_idx, 'cyrillic' from j where cyrillic and case when auto then confidence is null or confidence < 0.99 or {HAS['cyrillic']}
    else not "primary" or confidence is null or confidence < 0.82 or {HAS['cyrillic']} end
  union all
  select image_id, box_idx, 'korean' from j where korean and (not auto or confidence is null or confidence < 0.99 or {HAS['korean']}))
select * from u""",
    "tsv_words": f"with {TSV} select image_id, position, text, round(confidence, 6) as confidence from kept",
    "tsv_lines": f"""with {TSV},
g as (select image_id, blk, ln, min(l) as x, min(t) as y, max(l + wd) - min(l) as width, max(t + 16) - min(t) as height, string_agg(text, ' ' order by i) as text,
      sum(confidence * greatest(length(text), 1)) / sum(greatest(length(text), 1)) as confidence, count(*) as n_words from kept group by image_id, blk, ln)
select image_id, printf('line-%04d', row_number() over (partition by image_id order by blk, ln)) as line_id, x, y, width, height, text,
       round(confidence, 9) as confidence, n_words from g""",
    "tsv_pages": "select doc_id as image_id, 640.0::double as width, 4000.0::double as height from documents",
    "ctc_decode": f"""with {POSTERIORS},
d as (select item, string_agg(case token when 1 then 'a' when 2 then 'b' else ' ' end, '' order by step) as text, avg(score) as confidence, count(*) as n from kept group by item)
select vec_id as item, coalesce(text, '') as text, round(coalesce(confidence, 0), 6) as confidence, coalesce(n, 0) as n from embeddings left join d on item = vec_id""",
    "word_boxes": WORD_BOXES,
    "character_errors": f"""with {LETTERS_OF_PAIR}, e as (select *, levenshtein(a, b) as edits from spelled)
select conv_id, turn, edits, length(text) as reference_units, text = next as exact_match,
       round(case when length(text) > 0 then edits / length(text) when edits > 0 then 1 else 0 end, 6) as rate from e""",
    "validate_documents": VALID,
    "document_json": f"with {ORDERED} select image_id, true as same_text, count(*) as n_lines, 0 as n_errors from ordered group by image_id",
    "strict_documents": """with f as (select doc_id, doc_id % 43 = 0 as quotes, doc_id % 43 <> 0 and (doc_id % 37 = 0 or doc_id % 41 = 0) as again, doc_id % 29 = 0 or doc_id % 31 = 0 as more from documents),
k as (select doc_id, case when doc_id % 31 = 0 then 'after' when quotes then 'none' when again and more then 'none' when again then 'again' when more then 'after' else 'good' end as k from f)
select doc_id, (k = 'good' and doc_id % 19 = 0)::bigint as n_version, (k = 'good' and doc_id % 5 = 0)::bigint as n_width, (k = 'good' and doc_id % 17 = 0)::bigint as n_text,
       (k = 'good' and doc_id % 11 = 0)::bigint as n_order, (k = 'good' and doc_id % 23 = 0)::bigint as n_direction, (k = 'good' and doc_id % 13 = 0)::bigint as n_ignored,
       (k = 'good' and doc_id % 7 = 0)::bigint as n_status, (k = 'good' and doc_id % 3 = 0)::bigint as n_unknown, (k = 'after')::bigint as n_after, (k = 'again')::bigint as n_repeated,
       (k = 'none')::bigint as n_no_json from k""",
    "evaluate_documents": r"""with t as (select item_id as image_id, text, regexp_replace(text, '^[^ ]+ ', '') as cut from benchmark where item_id % 5 <> 0 and text is not null),
n as (select *, len(list_filter(string_split_regex(text, '[\t\n\v\f\r\x{85}\p{Z}]+'), lambda w: w <> '')) as a,
      len(list_filter(string_split_regex(cut, '[\t\n\v\f\r\x{85}\p{Z}]+'), lambda w: w <> '')) as b from t)
select image_id, length(text) - length(cut) as char_edits, a - b as word_edits, round(case when a > 0 then (a - b) / a else 0 end, 6) as word_rate, cut = text as exact_match from n""",
    "readable_lines": f"""with base as ({LINES}), n as (select *, row_number() over (partition by image_id order by position) as place from base),
t as (select image_id, line_id, {TRIM.format('text')} as text, confidence from n where place <= 7)
select * exclude (confidence) from t where confidence >= 0.5 and text <> ''""",
    "sha256_verify": """select cast(doc_id as varchar) as name, case when doc_id % 10 = 5 then 'missing' when doc_id % 10 = 4 then 'size'
       when doc_id % 10 = 3 then 'checksum' else 'ok' end as status from documents""",
    "profile_costs": f"""with {MODEL_ROWS}, profiles as ({_values([(i, *p) for i, p in enumerate(PROFILES)], 'k, quality, det, rec, max_side')})
select quality, max_side, any_value(d.bytes + r.bytes) as bytes, count(*) as documents from documents join profiles on k = doc_id % 4 join models d on det = d.model join models r on rec = r.model
group by quality, max_side""",
    "detection_matches": f"{MATCHES} select * from matched",
    "detection_scores": f"""{MATCHES},
n as (select image_id, count(*) as refs, count_if(line_id % 9 <> 0) as preds from base group by image_id),
h as (select image_id, count(*) as hits from matched group by image_id),
j as (select n.image_id, coalesce(hits, 0) as hits, coalesce(hits, 0) / preds as p, coalesce(hits, 0) / refs as r from n left join h using (image_id))
select image_id, hits, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as h_mean from j""",
    "polygon_matches": f"{TURNED} select * from matched",
    "end_to_end_scores": f"""{TURNED},
n as (select image_id, (select count(*) from refs where refs.image_id = d.image_id) as refs, (select count(*) from preds where preds.image_id = d.image_id) as preds,
      (select count(*) from matched where matched.image_id = d.image_id) as hits, (select count(*) from matched where matched.image_id = d.image_id and same_text) as text_hits
      from (select distinct image_id from regions) d),
s as (select *, case when preds > 0 then hits / preds end as p, case when refs > 0 then hits / refs end as r, case when preds > 0 then text_hits / preds end as tp, case when refs > 0 then text_hits / refs end as tr from n)
select image_id, refs, preds, hits, text_hits, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as h_mean,
       round(tp, 6) as e2e_precision, round(tr, 6) as e2e_recall, round(case when tp + tr > 0 then 2 * tp * tr / (tp + tr) else 0 end, 6) as e2e_h_mean from s""",
    "recognized_lines": f"""{RECOGNIZED}
select image_id, printf('line-%04d', number) as line_id, ord as line_order, text, round(confidence, 4) as confidence,
       case when image_id % 4 = 0 then case tag when 'Kore' then 'ko' when 'Jpan' then 'ja' end when image_id % 4 = 1 and tag = 'Latn' then 'de'
            when image_id % 4 = 2 and tag = 'Cyrl' then 'ru' when image_id % 4 = 2 and tag = 'Latn' then 'en' when image_id % 4 = 3 and tag = 'Kore' then 'ko' end as language,
       tag as script, len(toks) as n_words, n_alternatives, round(cast(cast(least(1200, x + w * cut_) as float) as double), 3) as first_word_x, y1::double as low from final""",
    "recognized_documents": f"""{RECOGNIZED}
select image_id, case when image_id % 7 <> 6 then coalesce(string_agg(text, chr(10) order by ord), '') end as text, count(text) as n_lines,
       case when image_id % 7 <> 6 then case image_id % 4 when 0 then '' when 1 then 'de' when 2 then 'ru,en' else 'ko' end end as hints,
       case when image_id % 7 <> 6 then 'v6-small-rec' end as model, case when image_id % 7 = 6 then 'unsupported languages xx' else '' end as errors
from images left join final using (image_id) group by image_id""",
    "request_outcomes": """with e as (select *, event_id - event_id % 3 as id, (event_id - event_id % 3) // 3 % 4 as worker from events),
r as (select worker, id, ts from e where event_id % 3 = 0),
s as (select case when user_id % 10 = 0 then worker + 1 else worker end as worker, id, ts, event_type <> 'error' as ok from e where event_id % 3 <> 0),
m as (select r.worker, r.id, r.ts as sent, s.ts as answered, ok, row_number() over (partition by r.worker, r.id order by s.ts, ok) as nth
      from r left join s on r.worker = s.worker and r.id = s.id and s.ts >= r.ts and s.ts <= r.ts + interval 5 minutes)
select worker, id, case when answered is null then 'timed out' when ok then 'ok' else 'failed' end as status,
       case when answered is null then 'no response within 5 minutes' when not ok then 'request failed' end as error, epoch_us(answered) - epoch_us(sent) as waited_us from m where nth = 1""",
    "download_progress": f"""with artifacts as ({_values(catalog.ARTIFACTS, 'artifact, bytes')}),
m as (select user_id, event_type, max(value * 1000) as loaded from events where event_type in (select artifact from artifacts) group by all),
t as (select user_id as session, coalesce((select sum(loaded) from m where m.user_id = e.user_id), 0) as loaded from (select distinct user_id from events) e)
select session, round(loaded, 3) as loaded, 1150000.0::double as total, round(least(0.9, loaded / 1150000 * 0.9), 6) as progress from t""",
    "boot_progress": f"""with models as ({_values(catalog.ARTIFACTS, 'model, bytes')}),
l as (select user_id, event_type, arg_max(value, event_id) as v, max(event_id) as e from events group by all),
d as (select user_id, sum(bytes * case when e % 4 < 2 then 1 else greatest(0, least(1, v / 150)) end) as done from l join models on model = event_type group by user_id)
select session, round(coalesce(done, 0) / 1150000, 6) as progress from (select distinct user_id as session from events) left join d on user_id = session""",
    "latency_percentiles": """select event_type, count(value) as n, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, true as sketch_within_bound from events group by event_type""",
    "image_orientations": """with d as (select doc_id, doc_id % 5 as k, doc_id * 37 % 5000 + 1 as w, doc_id * 91 % 4000 + 1 as h, doc_id % 10 as t from documents),
o as (select *, case when k <> 2 and t between 1 and 8 then t else 1 end as o from d)
select doc_id, ['png', 'jpeg', 'bmp', 'tiff', 'webp'][k + 1] as format, w as width, h as height, o as orientation, case when o >= 5 then h else w end as shown_width,
       case when o >= 5 then w else h end as shown_height, case when w * h > 10000000 then 'image has too many pixels' end as error from o""",
    "dictionary_entries": r"""with w as (select cast(item_id as varchar) as model, list_filter(string_split_regex(text, '[^\p{L}0-9''.,]+'), lambda w: w <> '' and w[1] <> chr(39)) as ws
from benchmark where text is not null)
select model, unnest(range(1, len(ws) + 1)) as position, unnest(ws) as entry from w""",
    "worker_responses": f"""with {_pairs(ALIAS, 'alias')},
d as (select doc_id, coalesce(lang, 'en') as l, doc_id % 8 as kind from documents where doc_id is not null),
c as (select doc_id, kind, coalesce(v, l) as code from d left join alias on k = l)
select case kind when 0 then concat('{{"id":', doc_id, ',"ok":true,"result":{{"method":"info","languages":[]}}}}')
  when 1 then concat('{{"id":', doc_id, ',"ok":true,"result":{{"method":"recognize","languages":["', code, case when code <> 'de' then '","de' else '' end, '"]}}}}')
  when 5 then '{{"ok":false,"error":"request is not a JSON object"}}' when 6 then '{{"ok":false,"error":"unknown member extra"}}'
  else concat('{{"id":', doc_id, ',"ok":false,"error":"', case kind when 2 then 'image is missing' when 3 then 'min_confidence must be between 0 and 1' when 4 then 'unknown method' else 'unsupported languages xx' end, '"}}') end as response
from c""",
    "image_headers": f"""with h as ({_values([(0, "png", 640, 320, None), (1, "bmp", 2, 3, None), (2, "jpeg", None, None, None), (3, None, None, None, "image format is not supported"), (4, None, None, None, "image is empty")], "k, format, width, height, error")})
select doc_id, format, width, height, error from documents join h on k = doc_id % 5""",
}
