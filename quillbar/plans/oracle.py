"""The registered queries as SQL for a second engine, written independently of the operators."""

from __future__ import annotations

from quillbar.functions import fixed_values as fixed
from quillbar.operators.stats import POISSON_STEPS
from quillbar.sources import inputs


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strings(values) -> str:
    return ", ".join(text(v) for v in values)


def tidy(value: str, digits: int = 6) -> str:
    return f"case when round({value}, {digits}) = 0 then 0e0 else round({value}, {digits}) end"


def tidied(names, digits: int = 6) -> str:
    return ", ".join(f"{tidy(n, digits)} as {n}" for n in names)


# ---- inputs --------------------------------------------------------------------------------

BARS = """bars as (
  select o_orderpriority as symbol, cast(o_orderdate as date) as date,
    round(100 + min_by(o_totalprice, o_orderkey) / 50000, 2) as open,
    round(100 + max(o_totalprice) / 50000, 2) as high,
    round(100 + min(o_totalprice) / 50000, 2) as low,
    round(100 + max_by(o_totalprice, o_orderkey) / 50000, 2) as close,
    count(*) as volume
  from orders group by 1, 2)"""

BARS_WIDE = """bars_wide as (
  select concat('S', l_suppkey) as symbol, cast(l_shipdate as date) as date,
    round(100 + min(l_extendedprice) / 50000, 2) as open, round(100 + max(l_extendedprice) / 50000, 2) as high,
    round(100 + min(l_extendedprice) / 50000, 2) as low, round(100 + max(l_extendedprice) / 50000, 2) as close,
    count(*) as volume
  from lineitem group by 1, 2)"""

HEADLINES = f"""headlines as (
  select doc_id as headline_id, date '1995-01-01' + cast((doc_id * 7) % 480 as int) as date,
    ([{strings(inputs.TICKERS)}])[1 + doc_id % 5] as symbol,
    ([{strings(inputs.TICKERS)}])[1 + doc_id % 5] || ' stock ' || ([{strings(inputs.KEYWORD_RING)}])[1 + (doc_id * 7) % 30]
      || ' ' || text || ([{strings(inputs.SUFFIX_RING)}])[1 + doc_id % 12] as headline, lang, source
  from documents)"""

TRUTH = """truth as (
  select doc_id as row_id, case when toxic = 1 then 'negative' when quality = 1 then 'positive' else 'neutral' end as y_true
  from labels)"""

PREDICTIONS = f"""{TRUTH}, weighed as (
  select m.model, t.row_id, t.y_true,
    case when t.row_id % (m.i + 2) = 0 then t.y_true
         else case (t.row_id + m.i) % 3 when 0 then 'negative' when 1 then 'neutral' else 'positive' end end as y_pred,
    (1 + (t.row_id * 3 + m.i * 5) % 7) as w0, (1 + (t.row_id * 5 + m.i * 5) % 7) as w1,
    (1 + (t.row_id * 2 + m.i * 5) % 7) as w2
  from truth t cross join (values (0, 'm0'), (1, 'm1'), (2, 'm2')) m(i, model)),
predictions as (
  select model, row_id, y_true, y_pred, w0 * 1e0 / (w0 + w1 + w2) as p_negative,
    w1 * 1e0 / (w0 + w1 + w2) as p_neutral, w2 * 1e0 / (w0 + w1 + w2) as p_positive
  from weighed)"""

EVALUATED = f"""{PREDICTIONS}, {HEADLINES}, {BARS}, evaluated as (
  select p.*, h.date, h.symbol, b.close
  from predictions p join headlines h on p.row_id = h.headline_id join bars b on b.symbol = h.symbol and b.date = h.date)"""


PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# ---- text ----------------------------------------------------------------------------------

W = r"[\p{L}\p{N}_]"
URL = r"https?://[a-zA-Z!$-_]+"
TOKEN = (
    r"n't\b|'(?:s|m|d|ll|re|ve)\b|\.\.\.|--|" + W + r"+(?:[-.]" + W + r"+|,\p{Nd}" + W + r"*)*|[^\s\p{L}\p{N}_]"
)


def removed(value: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({value}, {text(pattern)}, {text(by)}, 'g')"


def clean(value: str, hashtags: bool = False) -> str:
    out = removed(f"lower({value})", URL)
    out = removed(out, r"\S+@\S+")
    out = removed(out, r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b")
    out = removed(out, f"@{W}+")
    if hashtags:
        out = removed(out, f"#{W}+")
    return f"trim({removed(out, chr(92) + 's+', ' ')})"


def tokens(value: str) -> str:
    parted = removed(value, "(" + W + r")(n't|'(?:s|m|d|ll|re|ve))\b", r"\1 \2")
    return f"regexp_extract_all({parted}, {text(TOKEN)})"


TOKENS = f"""{HEADLINES}, tokens as (
  select headline_id, unnest(toks) as token, generate_subscripts(toks, 1) as pos
  from (select headline_id, {tokens(clean('headline'))} as toks from headlines))"""

LEXICON = "lexicon(token, polarity, subjectivity, valence) as (values " + ", ".join(
    f"({text(t)}, {p}::double, {s}::double, {v}::double)" for t, p, s, v in inputs.LEXICON) + ")"


def cut_label(value: str) -> str:
    return (f"case when {value} > {fixed.VALENCE_CUT} then 'positive' "
            f"when {value} < -{fixed.VALENCE_CUT} then 'negative' else 'neutral' end")


POLARITY = f"""{TOKENS}, {LEXICON}, polarity as (
  select h.headline_id, coalesce(avg(l.polarity), 0e0) as polarity, coalesce(avg(l.subjectivity), 0e0) as subjectivity,
    count(l.polarity) as n_hits
  from headlines h left join tokens t on t.headline_id = h.headline_id left join lexicon l on l.token = t.token
  group by 1)"""


def _boost(name: str, weight: float) -> str:
    return "case " + name + " " + " ".join(
        f"when {text(w)} then {v * weight!r}::double" for w, v in inputs.BOOSTERS.items()) + " else 0e0 end"


VALENCE = f"""{TOKENS}, {LEXICON}, placed as (
  select headline_id, pos, token, lag(token, 1) over w as b1, lag(token, 2) over w as b2, lag(token, 3) over w as b3
  from tokens window w as (partition by headline_id order by pos)),
moved as (
  select p.headline_id, (l.valence + sign(l.valence) * ({_boost('b1', 1.0)} + {_boost('b2', 0.95)} + {_boost('b3', 0.9)}))
      * case when b1 in ({strings(inputs.NEGATIONS)}) then {fixed.NEGATION_FACTOR}::double else 1e0 end
      * case when b2 in ({strings(inputs.NEGATIONS)}) then {fixed.NEGATION_FACTOR}::double else 1e0 end
      * case when b3 in ({strings(inputs.NEGATIONS)}) then {fixed.NEGATION_FACTOR}::double else 1e0 end as v
  from placed p left join lexicon l using (token)),
valence_sums as (
  select headline_id, coalesce(sum(v), 0e0) as s, coalesce(sum(v + 1) filter (v > 0), 0e0) as up,
    coalesce(sum(1 - v) filter (v < 0), 0e0) as down, (count(*) filter (coalesce(v, 0) = 0))::double as flat
  from moved group by 1),
valence as (
  select headline_id, s / sqrt(s * s + {fixed.VALENCE_ALPHA}) as compound, down / (up + down + flat) as p_negative,
    flat / (up + down + flat) as p_neutral, up / (up + down + flat) as p_positive
  from valence_sums)"""


def sentence_tokens() -> str:
    """Sentences and tokens word by word, with windows over the words of a text."""
    rate = "(select sum(dotted) / sum(n) from types)"

    def likelihood(p):
        return f"(dotted * ln(greatest({p}, 1e-9)) + (n - dotted) * ln(greatest(1 - {p}, 1e-9)))"

    score = f"""2 * ({likelihood(fixed.ABBREVIATION_PERIOD_RATE)} - {likelihood(rate)}) * exp(-length(replace(base, '.', '')))
      * (length(base) - length(replace(base, '.', '')) + 1) * pow(length(replace(base, '.', ''))::double, (dotted - n)::double)"""
    at = "strpos(w, core)"
    return f"""with {HEADLINES}, split as (select headline_id, regexp_extract_all(headline, '\\S+') as l from headlines),
words as (select headline_id, len(l) as size, unnest(l) as w, generate_subscripts(l, 1) as i from split),
cores as (select *, regexp_replace(w, '^["''(\\[{{]+|["'')\\]}}]+$', '', 'g') as core from words),
dots as (select *, core like '%.' and core not like '%..' as dotted from cores),
parts as (
  select *, lower(case when dotted then substr(core, 1, length(core) - 1) else core end) as base, regexp_matches(core, '^\\p{{Lu}}') as cap,
    regexp_matches(core, '^\\p{{Ll}}') as small, right(core, 1) in ('.', '!', '?') as stop,
    regexp_matches(core, '^\\p{{Lu}}\\.$') or core like '%..' as sure from dots),
near as (
  select *, lag(stop, 1, true) over w1 as after_stop, lead(base) over w1 as next, lead(cap) over w1 as next_cap
  from parts window w1 as (partition by headline_id order by i)),
types as (
  select base, count(*)::double as n, count(*) filter (dotted)::double as dotted, count(*) filter (small) as small,
    count(*) filter (cap and not after_stop) as inside from near group by 1),
short as (select base from types where dotted > 0 and regexp_matches(base, '\\p{{L}}') and {score} >= {fixed.ABBREVIATION_CUT}),
starters as (select base from types where small > 0 and inside = 0),
ended as (
  select *, i = size or (stop and not ((sure or (dotted and base in (select base from short)))
    and not (next_cap and next in (select base from starters)))) as is_end from near),
numbered as (select *, coalesce(sum(is_end::int) over (partition by headline_id order by i rows between unbounded preceding and 1 preceding), 0) as k from ended),
pieces as (
  select *, case when dotted and not is_end
    then list_concat(list_concat(regexp_extract_all(substr(w, 1, {at} - 1), '.'), [core]), regexp_extract_all(substr(w, {at} + length(core)), '.'))
    else flatten([case when lower(t) in ({strings(fixed.SPLIT_WORDS)}) then [substr(t, 1, 3), substr(t, 4)] else [t] end for t in {tokens('w')}]) end as toks
  from numbered),
lines as (select headline_id, k, string_agg(array_to_string(toks, '|'), '|' order by i) as line from pieces group by 1, 2),
texts as (select headline_id, count(*) as n, string_agg(line, chr(10) order by k) as text from lines group by 1)
select headline_id, cast(coalesce(n, 0) as int) as n_sentences, coalesce(text, '') as text from headlines left join texts using (headline_id)"""


def valence_rules() -> str:
    """The full valence rules over ``remarks``, word by word from lists."""
    lexicon = ", ".join(f"({text(t)}, {v}::double)" for t, v in inputs.RULE_LEXICON.items())
    single = {w: v for w, v in fixed.BOOSTER_WORDS.items() if " " not in w}
    up, down = ([w for w, v in single.items() if v * side > 0] for side in (1, -1))
    stages = []
    for k, weight in ((1, 1.0), (2, 0.95), (3, 0.9)):
        word = f"(case when i > {k} then l[i - {k}] end)"
        loud = f"loud and upper(w[i - {k}]) = w[i - {k}] and lower(w[i - {k}]) <> w[i - {k}]"
        step = f"case when {word} in ({strings(up)}) then {fixed.BOOST_STEP} when {word} in ({strings(down)}) then -{fixed.BOOST_STEP} else 0 end::double"
        step = f"({step} + case when {word} in ({strings(single)}) and {loud} then {fixed.CAPITALS_STEP} else 0 end::double) * {weight}"
        factor = f"when {word} in ({strings(fixed.NEGATION_WORDS)}) or contains({word}, 'n''t') then {fixed.NEGATION_FACTOR} else 1 end::double"
        if k > 1:
            so = " or ".join(f"l[i - {j}] in ('so', 'this')" for j in range(1, k))
            doubt = " or ".join(f"l[i - {j}] = 'doubt'" for j in range(1, k))
            factor = f"when {word} = 'never' and ({so}) then {fixed.NEVER_SO_FACTOR} when {word} = 'without' and ({doubt}) then 1 {factor}"
        stages.append(f"""v{k} as (select * exclude (v), case when i > {k} and l[i - {k}] not in (select token from lex)
    then (v + sign(v) * {step}) * case {factor} else v end as v from {'v0' if k == 1 else f'v{k - 1}'})""")
    spans = ["l[i-3:i-2]", "l[i-3:i-1]", "l[i-2:i-1]", "l[i-2:i]", "l[i-1:i]", "l[i-1:i+1]", "l[i:i+1]", "l[i:i+2]"]
    idiom = "coalesce(" + ", ".join(
        "case " + f"array_to_string({s}, ' ')" + " " + " ".join(f"when {text(p)} then {v}::double" for p, v in fixed.IDIOMS.items()) + " end" for s in reversed(spans)) + ", v)"
    several = " + ".join("case " + f"array_to_string({s}, ' ')" + " " + " ".join(
        f"when {text(p)} then {v}::double" for p, v in fixed.BOOSTER_WORDS.items() if " " in p) + " else 0 end" for s in spans[:3])
    shape = "upper(x) = x and lower(x) <> x"
    return f"""with {HEADLINES}, remarks as (
  select headline_id, case when headline_id % 40 = 7 then upper(headline || r) else headline || r end as t
  from (select headline_id, headline, ([{strings(inputs.REMARKS)}])[headline_id % 12 + 1] as r from headlines)),
lex(token, valence) as (values {lexicon}),
split as (
  select headline_id, t, [case when length(trim(x, {text(PUNCTUATION)})) > 2 then trim(x, {text(PUNCTUATION)}) else x end
    for x in regexp_extract_all(t, '\\S+')] as w from remarks),
rows_of as (
  select headline_id, w, [lower(x) for x in w] as l, len([x for x in w if {shape}]) between 1 and len(w) - 1 as loud,
    least(length(t) - length(replace(t, '!', '')), {fixed.MOST_EXCLAMATIONS}) * {fixed.EXCLAMATION_STEP}::double
      + case when length(t) - length(replace(t, '?', '')) < 2 then 0 when length(t) - length(replace(t, '?', '')) <= 3
             then (length(t) - length(replace(t, '?', ''))) * {fixed.QUESTION_STEP} else {fixed.QUESTION_MOST} end::double as emph
  from split),
placed as (select *, coalesce(list_position(l, 'but'), 0) as b, unnest(generate_series(1, len(w))) as i from rows_of),
hits as (select p.*, x.valence from placed p join lex x on x.token = l[i]),
v0 as (
  select *, u + sign(u) * case when loud and upper(w[i]) = w[i] and lower(w[i]) <> w[i] then {fixed.CAPITALS_STEP} else 0 end::double as v from (
    select *, case when (i > 1 and l[i - 1] = 'no') or (i > 2 and l[i - 2] = 'no') or (i > 3 and l[i - 3] = 'no' and l[i - 1] in ('or', 'nor'))
      then valence * {fixed.NEGATION_FACTOR}::double when l[i] = 'no' and l[i + 1] in (select token from lex) then 0e0 else valence end as u from hits)),
{', '.join(stages)},
phrased as (select * exclude (v), case when i > 3 and l[i - 3] not in (select token from lex) then {idiom} + {several} else v end as v from v3),
done as (
  select headline_id, emph, case when l[i] in ({strings(single)}) or (l[i] = 'kind' and l[i + 1] = 'of') then 0 else
    v * case when i > 1 and l[i - 1] = 'least' and not (i > 2 and l[i - 2] in ('at', 'very')) then {fixed.NEGATION_FACTOR}::double else 1 end
      * case when b = 0 or i = b then 1 when i < b then {fixed.BEFORE_BUT}::double else {fixed.AFTER_BUT}::double end end as v
  from phrased),
sums as (
  select r.headline_id, any_value(r.emph) as emph, any_value(len(r.w)) as n, coalesce(sum(v), 0e0) as s, coalesce(sum(v + 1) filter (v > 0), 0e0) as up,
    coalesce(sum(1 - v) filter (v < 0), 0e0) as down, count(*) filter (v <> 0) as felt
  from rows_of r left join done d using (headline_id) group by 1),
total as (
  select headline_id, s + sign(s) * emph as s, up + case when up > down then emph else 0 end as up,
    down + case when down > up then emph else 0 end as down, (n - felt)::double as flat from sums),
scored as (
  select headline_id, s / sqrt(s * s + {fixed.VALENCE_ALPHA}) as compound, coalesce(down / nullif(up + down + flat, 0), 0e0) as p_negative,
    coalesce(flat / nullif(up + down + flat, 0), 1e0) as p_neutral, coalesce(up / nullif(up + down + flat, 0), 0e0) as p_positive from total)
select headline_id, {tidied(['compound', 'p_negative', 'p_neutral', 'p_positive'])}, {cut_label('compound')} as y_pred from scored"""


def nb(train: str, test: str) -> str:
    """Naive Bayes CTEs: ``train(headline_id, label)``, ``test(headline_id)`` over ``tokens``."""
    cols = fixed.LABELS
    return f"""nb_counts as (
  select token, {', '.join(f"count(*) filter (label = '{c}') as n_{c}" for c in cols)}
  from tokens join {train} using (headline_id) group by 1),
nb_totals as (select count(*) as v, {', '.join(f'sum(n_{c}) as t_{c}' for c in cols)} from nb_counts),
nb_words as (select token, {', '.join(f'ln((n_{c} + 1e0) / (t_{c} + v)) as l_{c}' for c in cols)} from nb_counts, nb_totals),
nb_priors as (select {', '.join(f"ln((count(*) filter (label = '{c}')) * 1e0 / count(*)) as l_{c}" for c in cols)} from {train}),
nb_sums as (
  select headline_id, {', '.join(f'sum(l_{c}) as s_{c}' for c in cols)}
  from {test} join tokens using (headline_id) join nb_words using (token) group by 1),
nb_scores as (
  select t.headline_id, {', '.join(f'coalesce(s_{c}, 0e0) + p.l_{c} as score_{c}' for c in cols)}
  from {test} t left join nb_sums using (headline_id) cross join nb_priors p),
nb as (
  select *, case when score_negative >= score_neutral and score_negative >= score_positive then 'negative'
                 when score_neutral >= score_positive then 'neutral' else 'positive' end as y_pred,
    greatest(score_negative, score_neutral, score_positive) as top
  from nb_scores)"""


# ---- bars ----------------------------------------------------------------------------------

S = "partition by symbol order by date"


def full(agg: str, value: str, n: int, part: str = S) -> str:
    frame = f"({part} rows between {n - 1} preceding and current row)"
    return f"case when count({value}) over {frame} >= {n} then {agg}({value}) over {frame} end"


def indicator_ctes(source: str) -> str:
    return f"""deltas as (
  select *, close / nullif(lag(close) over ({S}), 0) - 1 as price_change_1d,
    close / nullif(lag(close, 7) over ({S}), 0) - 1 as price_change_7d,
    coalesce(close - lag(close) over ({S}), 0) as delta
  from {source}),
rolled as (
  select *, {full('avg', 'volume', 20)} as volume_20d_avg, {full('stddev_samp', 'price_change_1d', 7)} as volatility_7d,
    {full('stddev_samp', 'price_change_1d', 20)} as volatility_20d,
    {full('avg', 'greatest(delta, 0)', 14)} as gain, {full('avg', 'greatest(-delta, 0)', 14)} as loss,
    {full('avg', 'close', 5)} as ma_5d, {full('avg', 'close', 20)} as ma_20d, {full('avg', 'close', 50)} as ma_50d
  from deltas),
indicators as (
  select *, volume / nullif(volume_20d_avg, 0) as volume_ratio,
    case when loss = 0 then case when gain > 0 then 100e0 end else 100 - 100 / (1 + gain / loss) end as rsi_14d,
    close / nullif(ma_5d, 0) - 1 as price_vs_ma5, close / nullif(ma_20d, 0) - 1 as price_vs_ma20,
    close / nullif(ma_50d, 0) - 1 as price_vs_ma50
  from rolled)"""


INDICATOR_NAMES = [
    "price_change_1d", "price_change_7d", "volume_20d_avg", "volume_ratio", "volatility_7d", "volatility_20d",
    "rsi_14d", "ma_5d", "ma_20d", "ma_50d", "price_vs_ma5", "price_vs_ma20", "price_vs_ma50",
]
INDICATORS = f"{BARS}, {indicator_ctes('bars')}"


def label(value: str) -> str:
    return (f"case when {value} is null then null when {value} > 0.02 then 'positive' "
            f"when {value} < -0.02 then 'negative' else 'neutral' end")


LABELLED = f"""{HEADLINES}, {BARS}, merged as (
  select h.headline_id, h.date, h.symbol, b.close from headlines h join bars b on b.symbol = h.symbol and b.date = h.date),
returned as (
  select *, lead(close) over (partition by symbol order by date, headline_id) / nullif(close, 0) - 1 as future_return
  from merged),
labelled as (select *, {label('future_return')} as sentiment_label from returned)"""


def split_of(source: str) -> str:
    return f"""placed_rows as (
  select *, row_number() over (order by date, headline_id) - 1 as place, count(*) over () as total from {source}),
parts as (
  select *, case when place < floor(total * 0.7e0) then 'train'
                 when place < floor(total * (0.7e0 + 0.15e0)) then 'val' else 'test' end as split
  from placed_rows)"""


# ---- metrics -------------------------------------------------------------------------------

def count_metrics(source: str) -> str:
    per_class = []
    for c in fixed.LABELS:
        tp = f"(count(*) filter (y_true = '{c}' and y_pred = '{c}'))"
        support, predicted = f"(count(*) filter (y_true = '{c}'))", f"(count(*) filter (y_pred = '{c}'))"
        present = f"{support} + {predicted} > 0"
        per_class += [
            f"case when {present} then coalesce({tp} * 1e0 / nullif({predicted}, 0), 0) end as precision_{c}",
            f"case when {present} then coalesce({tp} * 1e0 / nullif({support}, 0), 0) end as recall_{c}",
            f"case when {present} then coalesce(2e0 * {tp} / nullif({support} + {predicted}, 0), 0) end as f1_{c}",
            f"{support} as support_{c}",
        ]
    def macro(m):
        return f"(select avg(x) from (values {', '.join(f'({m}_{c})' for c in fixed.LABELS)}) v(x))"
    weighted = " + ".join(f"coalesce(f1_{c}, 0) * support_{c}" for c in fixed.LABELS)
    return f"""by_class as (
  select model, count(*) as n, avg(case when y_true = y_pred then 1e0 else 0e0 end) as accuracy, {', '.join(per_class)}
  from {source} group by model),
counted as (
  select *, {macro('precision')} as precision_macro, {macro('recall')} as recall_macro, {macro('f1')} as f1_macro,
    ({weighted}) / n as f1_weighted
  from by_class)"""


MAIN = ["accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted"]
PER_CLASS = [f"{m}_{c}" for c in fixed.LABELS for m in ("precision", "recall", "f1")]
COUNTED = f"{PREDICTIONS}, {count_metrics('predictions')}"

RANK_ROWS = """class_rows as (
  select model, 'negative' as class, p_negative as score, y_true from predictions union all
  select model, 'neutral', p_neutral, y_true from predictions union all
  select model, 'positive', p_positive, y_true from predictions),
by_score as (
  select model, class, score, count(*) filter (y_true = class) as pos, count(*) filter (y_true <> class) as neg
  from class_rows group by 1, 2, 3)"""
RANKED = RANK_ROWS + """,
totals as (select model, class, sum(pos) as p, sum(neg) as q from by_score group by 1, 2),
pair_sums as (
  select a.model, a.class, sum(a.pos * b.neg * case when a.score > b.score then 1e0 when a.score = b.score then 0.5e0 else 0e0 end) as won
  from by_score a join by_score b on a.model = b.model and a.class = b.class group by 1, 2),
swept as (
  select *, sum(pos) over w as tp, sum(pos + neg) over w as seen
  from by_score window w as (partition by model, class order by score desc rows between unbounded preceding and current row)),
areas as (select model, class, sum(tp * 1e0 / seen * pos) as area from swept group by 1, 2),
ranked as (
  select model, case when count(won / nullif(p * q, 0)) = 3 then avg(won / nullif(p * q, 0)) end as auc_roc,
    case when count(won / nullif(p * q, 0)) = 3 then avg(area / nullif(p, 0)) end as auc_pr
  from totals join pair_sums using (model, class) join areas using (model, class) group by 1)"""


SIGNAL = "case y_pred when 'positive' then 1 when 'negative' then -1 when 'neutral' then 0 end"


def strategy_rows(source: str, by: str, order: str, frame_signal: bool = False) -> str:
    part = f"partition by {by + ', ' if by else ''}symbol order by {order}"
    lag_part = f"{'partition by ' + by if by else ''} order by {order}" if frame_signal else part
    return f"""signalled as (select *, {SIGNAL} as signal from {source}),
earned as (
  select *, close / nullif(lag(close) over ({part}), 0) - 1 as returns, lag(signal) over ({lag_part}) as held from signalled),
all_rows as (select *, held * returns as strategy_returns from earned),
strat as (select * from all_rows where strategy_returns is not null)"""


def curve(source: str, by: str, order: str, value: str = "strategy_returns") -> str:
    w = f"({'partition by ' + by if by else ''} order by {order} rows between unbounded preceding and current row)"
    return f"""grown as (select *, product(1 + {value}) over {w} as equity from {source}),
peaked as (select *, max(equity) over {w} as peak from grown),
curve as (select *, (equity - peak) / peak as drawdown from peaked)"""


STRATEGY = ["total_return", "annualized_return", "volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown",
            "calmar_ratio", "hit_rate", "num_trades", "avg_trade_return", "win_rate"]
STRATEGY_TIDY = [m for m in STRATEGY if m != "num_trades"]


def summary(by: str, trades: str, trade_sum: str, wins: str) -> str:
    r = "strategy_returns"
    return f"""base as (
  select {by}, count(*) as n_rows, product(1 + {r}) - 1 as total_return, date_diff('day', min(date), max(date)) as days,
    stddev_samp({r}) * sqrt(252) as volatility, (stddev_samp({r}) filter ({r} < 0)) * sqrt(252) as downside,
    min(drawdown) as max_drawdown, avg(case when {r} > 0 then 1e0 else 0e0 end) as hit_rate,
    cast({trades} as bigint) as trades, {trade_sum} as trade_sum, {wins} as wins
  from curve group by {by}),
yearly as (
  select *, case when days > 0 and 1 + total_return >= 0 then pow(1 + total_return, 1 / (days / 365.25e0)) - 1 end as annualized_return
  from base),
metrics as (
  select *, case when volatility > 0 then (annualized_return - 0.02) / volatility end as sharpe_ratio,
    case when downside > 0 then (annualized_return - 0.02) / downside end as sortino_ratio,
    annualized_return / nullif(abs(max_drawdown), 0) as calmar_ratio, nullif(trades, 0) as num_trades,
    trade_sum / nullif(trades, 0) as avg_trade_return, wins * 1e0 / nullif(trades, 0) as win_rate,
    case when volatility > 0 then (total_return * 252 - 0.02) / volatility else 0e0 end as sharpe_simple
  from yearly)"""


ROW_TRADES = ("count(*) filter (signal is null or signal <> 0)", "sum(strategy_returns) filter (signal is null or signal <> 0)",
              "count(*) filter ((signal is null or signal <> 0) and strategy_returns > 0)")
RUN = f"{EVALUATED}, {strategy_rows('evaluated', 'model', 'date, row_id')}, {curve('strat', 'model', 'date, row_id')}, {summary('model', *ROW_TRADES)}"

BAR_PREDICTIONS = f"""{BARS}, bar_rows as (
  select symbol, date, close, case date_diff('day', date '1995-01-01', date) % 3
    when 0 then 'negative' when 1 then 'neutral' else 'positive' end as y_pred
  from bars)"""
BAR_ROWS = f"{BAR_PREDICTIONS}, {strategy_rows('bar_rows', '', 'date')}"
BAR_DAILY = f"""{BAR_ROWS}, daily as (
  select date, avg(strategy_returns) as strategy, avg(returns) as benchmark from all_rows group by 1)"""
WEIGHTS = f"""{BAR_ROWS}, actives as (select date, count(*) as n from all_rows where signal <> 0 group by 1),
weighted as (
  select a.*, coalesce(a.signal * least(1e0 / n, 0.3e0), 0e0) as weight from all_rows a left join actives using (date))"""


def rebalanced(period: str) -> str:
    return f"""held_weights as (
  select * replace (first_value(weight) over (partition by symbol, date_trunc('{period}', date) order by date) as weight)
  from weighted)"""


def folds(train: str) -> str:
    return f"""{HEADLINES}, days as (
  select date, row_number() over (order by date) - 1 as i, count(*) over () as n from (select distinct date from headlines)),
blocks as (
  select f.fold, greatest(1, cast(floor(n * 0.2e0 / 5) as int)) as block, n
  from (select max(n) as n from days), (values (0), (1), (2), (3), (4)) f(fold)),
bounds as (
  select fold, (select date from days where i = b.n - (5 - fold) * block) as test_start,
    (select date from days where i = b.n - (5 - fold) * block + block - 1) as test_end
  from blocks b where b.n - (5 - fold) * block > 0)
select headline_id, fold, case when date between test_start and test_end then 'test' else 'train' end as part
from headlines, bounds where date between test_start and test_end or {train}"""


def hash_int(parts: str) -> str:
    return f"cast('0x' || substr(md5({parts}), 1, 8) as bigint)"


SCORED = f"""{PREDICTIONS}, {HEADLINES}, scored as (
  select model, row_id, date, case when y_true = y_pred then 1 else 0 end as hit, case when y_true = y_pred then 0 else 1 end as loss
  from predictions join headlines on row_id = headline_id)"""


def weights(units: str) -> str:
    draw = hash_int("'42:boot:' || replicate || ':' || date") + " / 4294967296e0"
    steps = " + ".join(f"case when u >= {s!r}::double then 1 else 0 end" for s in POISSON_STEPS)
    return f"""draws as (
  select date, replicate, {steps} as w
  from (select date, replicate, {draw} as u from (select distinct date from {units}), range(1, 1001) r(replicate)))"""


DIFFERENTIAL = f"""{SCORED}, per_day as (select date, model, avg(loss) as loss from scored group by 1, 2),
differential as (
  select o.model, o.date, b.loss - o.loss as d from per_day o join per_day b on b.date = o.date and b.model = 'm2' where o.model <> 'm2')"""


def _vocabulary() -> str:
    return f"vocabulary as (select distinct unnest({tokens(clean('text'))}) as lemma from benchmark)"


def lemma_ctes() -> str:
    endings = " union all ".join(
        f"select token, {i} as i, substr(token, 1, length(token) - {len(e)}) || '{r}' as form from words where token like '%{e}'"
        for i, (e, r) in enumerate(fixed.NOUN_ENDINGS, 1))
    special = ", ".join(f"({text(a)}, {text(b)})" for a, b in inputs.LEMMA_EXCEPTIONS)
    return f"""{_vocabulary()}, words as (select distinct token from tokens),
special(token, lemma) as (values {special}),
forms as (select token, 0 as i, token as form from words union all {endings}),
best as (
  select token, form from (
    select token, form, row_number() over (partition by token order by length(form), i) as rn
    from forms join vocabulary on form = lemma) where rn = 1),
lemmas as (
  select words.token, coalesce(special.lemma, best.form, words.token) as lemma
  from words left join special using (token) left join best using (token))"""


PROTECTED = set(fixed.PROTECTED_TERMS)


def kept_words() -> str:
    return strings(w for w in fixed.ENGLISH_STOP_WORDS if w not in PROTECTED)


def has_any(words, value: str = "lower(headline)") -> str:
    return " or ".join(f"contains({value}, {text(w)})" for w in words)


def whole_word(words) -> str:
    return f"regexp_matches(lower(headline), '(?:^|[^\\p{{L}}\\p{{N}}_])(?:{'|'.join(words)})(?:[^\\p{{L}}\\p{{N}}_]|$)')"


FLAGS = f"""flagged as (
  select *, {has_any(fixed.EARNINGS_WORDS)} as has_earnings_keywords, {has_any(fixed.MERGER_WORDS)} as has_merger_keywords,
    {has_any(fixed.REGULATORY_WORDS)} as has_regulatory_keywords,
    regexp_matches(headline, '\\$(\\d+(?:\\.\\d{{2}})?)') as has_price_target,
    regexp_matches(headline, '(\\d+(?:\\.\\d+)?%)') as has_percentage,
    regexp_matches(headline, '\\$(\\d+(?:,\\d{{3}})*(?:\\.\\d{{2}})?)') as has_dollar_amount
  from headlines)"""
FLAG_NAMES = ["has_earnings_keywords", "has_merger_keywords", "has_regulatory_keywords",
              "has_price_target", "has_percentage", "has_dollar_amount"]


def _series(ctes: str, source: str, column: str) -> str:
    return f"with {ctes} select symbol, date, {tidy(column)} as {column} from {source}"


def _text(expression: str) -> str:
    return f"with {HEADLINES} select headline_id, {expression} as text from headlines"


def comparison_end_to_end() -> str:
    def model(name: str, source: str, pred: str) -> str:
        return f"select '{name}' as model, headline_id as row_id, {pred} as y_pred from {source} join test using (headline_id)"

    return f"""{TOKENS}, {LABELLED.replace(HEADLINES + ', ', '', 1)}, known as (select * from labelled where sentiment_label is not null),
{split_of('known')},
train as (select headline_id, sentiment_label as label from parts where split = 'train'),
test as (select headline_id, date, symbol, close, sentiment_label from parts where split = 'test'),
{POLARITY.replace(TOKENS + ', ', '', 1)}, {VALENCE.replace(TOKENS + ', ' + LEXICON + ', ', '', 1)}, {nb('train', 'test')},
top_label as (
  select label from train group by 1
  order by count(*) desc, case label when 'negative' then 0 when 'neutral' then 1 else 2 end limit 1),
scored as (
  {model('polarity', 'polarity', cut_label('polarity'))} union all {model('valence', 'valence', cut_label('compound'))}
  union all {model('naive_bayes', 'nb', 'y_pred')}
  union all select 'majority', headline_id, (select label from top_label) from test),
evaluated as (
  select s.model, s.row_id, s.y_pred, t.date, t.symbol, t.close, t.sentiment_label as y_true
  from scored s join test t on s.row_id = t.headline_id),
{count_metrics('evaluated')}, {strategy_rows('evaluated', 'model', 'date, row_id')}, {curve('strat', 'model', 'date, row_id')},
{summary('model', *ROW_TRADES)}
select model, n, {tidied([*MAIN, 'total_return', 'hit_rate'])} from counted left join metrics using (model)"""


def chance(name: str, key: str) -> str:
    return f"({hash_int(f"'42:{name}:' || {key}")} / 4294967296e0)"


def bell(name: str, key: str) -> str:
    radius, angle = (hash_int(f"'42:{name}:' || {key} || ':{part}'") for part in "ra")
    return f"(sqrt(-2e0 * ln(1e0 - {radius} / 4294967296e0)) * cos(2e0 * pi() * ({angle} / 4294967296e0)))"


def ring(values, name: str, key: str) -> str:
    return f"([{strings(values)}])[1 + {hash_int(f"'42:{name}:' || {key}")} % {len(values)}]"


def synth_headlines() -> str:
    def by_label(make):
        return (f"case sentiment_label when 'positive' then {make('positive')} when 'negative' then {make('negative')} "
                f"else {make('neutral')} end")

    key = "headline_id"
    pattern = by_label(lambda c: ring(fixed.TEMPLATES[c], "template", key))
    keyword = by_label(lambda c: ring(fixed.KEYWORDS[c], "keyword", key))
    return f"""drawn as (
  select doc_id as headline_id, date '2020-01-01' + cast({hash_int("'42:date:' || doc_id")} % 1461 as int) as date,
    {ring(fixed.SYMBOLS, 'symbol', 'doc_id')} as symbol, {chance('label', 'doc_id')} as u from documents),
labelled_drawn as (
  select *, case when u < 0.4e0 then 'positive' when u < 0.4e0 + 0.3e0 then 'neutral' else 'negative' end as sentiment_label from drawn),
written as (
  select *, replace(replace({pattern}, '{{k}}', {keyword}), '{{s}}', symbol) || case when {chance('focus', key)} < 0.3e0
    then ' with focus on ' || {ring(fixed.FOCUS_TERMS, 'term', key)} else '' end as headline from labelled_drawn)"""


def synth_bars(impact: bool = False) -> str:
    key = "symbol || ':' || date"
    push = "* (1 + coalesce(impact, 0e0))" if impact else ""
    source = "bars left join impacts using (symbol, date)" if impact else "bars"
    return f"""days as (
  select *, row_number() over ({S}) - 1 as i, count(*) over (partition by symbol) as n from {source}),
steps as (
  select *, case when i = 0 then 1e0 else exp((0.05e0 - 0.5e0 * pow(0.2e0, 2)) * (1e0 / 252) + 0.2e0 * sqrt(1e0 / 252) * {bell('walk', key)})
    * case when {chance('jump', key)} < 0.1e0 then 1 + 0.05e0 * {bell('size', key)} else 1e0 end {push} end as step from days),
path as (
  select symbol, date, i, n, 100e0 * product(step) over ({S} rows between unbounded preceding and current row) as c from steps),
opened as (select *, c * (1 + 0.01e0 * {bell('open', key)}) as o from path),
synth as (
  select date, symbol, round(o, 2) as open, round(greatest(o, c) * (1 + abs(0.005e0 * {bell('high', key)})), 2) as high,
    round(least(o, c) * (1 - abs(0.005e0 * {bell('low', key)})), 2) as low, round(c, 2) as close,
    cast(trunc(greatest(1000000 * (1 + coalesce(0.2e0 * i / nullif(n - 1, 0), 0) + 0.1e0 * sin(2 * pi() * i / 252)
      + 0.3e0 * {bell('volume', key)}), 100000e0)) as bigint) as volume from opened)"""


def statements() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["synth_headlines"] = f"""with {synth_headlines()} select headline_id, date, symbol, headline, sentiment_label,
cast(length(headline) as int) as text_length,
cast(len(list_filter(regexp_split_to_array(headline, '\\s+'), lambda x: x <> '')) as int) as word_count from written"""
    sql["synth_bars"] = f"with {BARS}, {synth_bars()} select * from synth"
    sql["synth_bars_indicators"] = f"""with {BARS}, {synth_bars()}, {indicator_ctes('synth')}
select date, symbol, open, high, low, close, volume, {tidied(INDICATOR_NAMES)} from indicators"""
    sql["synth_bars_impact"] = f"""with {BARS}, {TRUTH}, {HEADLINES}, impacts as (
  select symbol, date + 1 as date, avg(case y_true when 'positive' then 1e0 when 'negative' then -1e0 else 0e0 end) * 0.02e0 as impact
  from headlines join truth on row_id = headline_id group by 1, 2), {synth_bars(True)} select * from synth"""
    sql["bars_load"] = f"""select o_orderpriority as symbol, cast(o_orderdate as date) as date, o_totalprice as close, o_orderkey as tick
from orders where o_orderpriority in ({strings(inputs.TICKERS[:3])}) and o_orderdate >= '1995-01-01' and o_orderdate < '1997-01-01'"""
    sql["bars_filter"] = f"""with {BARS} select * from bars where symbol in ('1-URGENT', '5-LOW')
and date >= date '1996-01-01' and date < date '1998-01-01'"""
    sql["bars_normalize"] = f"with {BARS} select * from bars"
    sql["bars_wide_to_long"] = f"""with {BARS} select d.date, s.symbol, open, high, low, close, volume
from (select distinct date from bars) d cross join (select distinct symbol from bars) s
left join bars b on b.date = d.date and b.symbol = s.symbol"""
    sql["bars_union"] = f"with {BARS}, {BARS_WIDE} select * from bars union all select * from bars_wide"

    sql["headline_shape"] = f"""with {HEADLINES} select headline_id, cast(length(headline) as int) as text_length,
cast(len(list_filter(regexp_split_to_array(headline, '\\s+'), lambda x: x <> '')) as int) as word_count from headlines"""
    sql["preview"] = f"with {HEADLINES} select headline_id, date, symbol, headline from headlines order by date, headline_id limit 10"
    sql["sample_n"] = f"""with {HEADLINES} select headline_id, date, symbol from headlines
order by {hash_int("'42:' || headline_id")}, headline_id limit 200"""
    sql["label_distribution"] = f"with {TRUTH} select y_true, count(*) as n from truth group by 1"
    sql["dataset_overview"] = f"""with {HEADLINES} select count(*) as n_rows, count(distinct symbol) as n_symbols, min(date) as first_date,
max(date) as last_date, {tidy('avg(length(headline))')} as mean_text_length from headlines"""

    sql["headline_bar_join"] = f"""with {HEADLINES}, {BARS} select h.date, h.symbol, headline_id, lang, source, open, high, low, close, volume
from headlines h join bars b on h.date = b.date and h.symbol = b.symbol"""
    daily = f"""{POLARITY}, {BARS}, daily as (
  select symbol, date, avg(polarity) as sentiment from headlines join polarity using (headline_id) group by 1, 2)"""
    sql["sentiment_price_overlay"] = f"""with {daily} select b.symbol, b.date, close, {tidy('sentiment')} as sentiment
from bars b left join daily d on d.symbol = b.symbol and d.date = b.date"""
    moment = "date_diff('day', date '1970-01-01', cast({} as date)) * 86400 + ({}) % 86400"
    sql["asof_ticks"] = f"""with t as (
  select o_orderkey as row_id, o_orderpriority as symbol, {moment.format('o_orderdate', 'o_orderkey')} as at from orders),
p as (
  select case when l_suppkey % 3 = 0 then {text(inputs.TICKERS[0])} else ([{strings(inputs.TICKERS)}])[l_suppkey % 5 + 1] end as symbol,
    {moment.format('l_shipdate', 'l_orderkey * 131 + l_linenumber * 7')} as at, max_by(l_discount, l_orderkey * 10 + l_linenumber) as value
  from lineitem group by 1, 2)
select row_id, t.symbol, value, (t.at - p.at)::double as age_seconds from t asof left join p on t.symbol = p.symbol and t.at >= p.at"""
    sql["sentiment_asof"] = f"""with {daily} select b.symbol, b.date, close, {tidy('sentiment')} as sentiment
from bars b asof left join daily d on d.symbol = b.symbol and d.date <= b.date"""
    sql["sentiment_interpolate"] = f"""with {daily}, sides as (
  select b.symbol, b.date, b.close, p.date as d0, p.sentiment as s0, n.date as d1, n.sentiment as s1
  from bars b asof left join daily p on p.symbol = b.symbol and p.date <= b.date
  asof left join daily n on n.symbol = b.symbol and n.date >= b.date)
select symbol, date, close, {tidy('''case when d0 is null then s1 when d1 is null then s0 when d0 = d1 then s0
  else s0 + (s1 - s0) * date_diff('day', d0, date) / date_diff('day', d0, d1) end''')} as sentiment from sides"""

    for name, column in [("ret_1d", "price_change_1d"), ("ret_7d", "price_change_7d"), ("volume_avg_20", "volume_20d_avg"),
                         ("volume_ratio", "volume_ratio"), ("volatility_7", "volatility_7d"), ("volatility_20", "volatility_20d"),
                         ("rsi_14", "rsi_14d"), ("ma_5", "ma_5d"), ("ma_20", "ma_20d"), ("ma_50", "ma_50d")]:
        sql[name] = _series(INDICATORS, "indicators", column)
    vs = ["price_vs_ma5", "price_vs_ma20", "price_vs_ma50"]
    sql["price_vs_ma"] = f"with {INDICATORS} select symbol, date, {tidied(vs)} from indicators"
    frame = "order by symbol, date"
    sql["rsi_14_frame"] = _series(f"""{BARS}, deltas as (select *, coalesce(close - lag(close) over ({frame}), 0) as delta from bars),
rolled as (select *, {full('avg', 'greatest(delta, 0)', 14, frame)} as gain, {full('avg', 'greatest(-delta, 0)', 14, frame)} as loss from deltas),
indicators as (select *, case when loss = 0 then case when gain > 0 then 100e0 end else 100 - 100 / (1 + gain / loss) end as rsi_14d from rolled)""",
                                  "indicators", "rsi_14d")
    every = f"select symbol, date, open, high, low, close, volume, {tidied(INDICATOR_NAMES)} from indicators"
    sql["technical_indicators"] = f"with {INDICATORS} {every}"
    sql["technical_indicators_wide"] = f"with {BARS_WIDE}, {indicator_ctes('bars_wide')} {every}"
    sql["future_return"] = f"""with {BARS}, ahead as (select *, lead(close, 5) over ({S}) / nullif(close, 0) - 1 as future_return from bars)
select symbol, date, {tidy('future_return')} as future_return from ahead"""
    sql["label_bars"] = f"""with {BARS}, ahead as (select symbol, date, close, lead(close) over ({S}) / nullif(close, 0) - 1 as future_return from bars)
select symbol, date, close, {tidy('future_return')} as future_return, {label('future_return')} as sentiment_label from ahead"""
    sql["label_rows"] = f"""with {LABELLED} select headline_id, date, symbol, close, {tidy('future_return')} as future_return,
sentiment_label from labelled"""
    ticks = """ticks as (
  select o_orderkey as row_id, cast(o_orderdate as date) as date, o_orderpriority as symbol, round(100 + o_totalprice / 50000, 2) as close
  from orders)"""
    for name, h in [("label_rows_ticks", 1), ("label_rows_ticks_5", 5)]:
        sql[name] = f"""with {ticks}, ahead as (select *, lead(close, {h}) over (partition by symbol order by date, row_id) / nullif(close, 0) - 1
  as future_return from ticks) select row_id, symbol, {tidy('future_return')} as future_return, {label('future_return')} as sentiment_label from ahead"""
    sql["technical_indicators_ticks"] = f"""with {ticks}, volumes as (select *, 1 + row_id % 100 as volume from ticks),
{indicator_ctes('volumes').replace(S, 'partition by symbol order by date, row_id')}
select row_id, symbol, {tidied(INDICATOR_NAMES)} from indicators"""
    tick_rows = f"""{ticks}, tick_rows as (
  select 'all' as model, row_id, date, symbol, 100 + (close - 100) / 100 as close, case date_diff('day', date '1995-01-01', date) % 3
    when 0 then 'negative' when 1 then 'neutral' else 'positive' end as y_pred from ticks)"""
    shown = f"n_rows, {tidied(STRATEGY_TIDY)}, num_trades"
    sql["strategy_metrics_ticks"] = f"""with {tick_rows}, {strategy_rows('tick_rows', 'model', 'date, row_id', True)},
{curve('strat', 'model', 'date, row_id')}, {summary('model', *ROW_TRADES)} select model, {shown} from metrics"""
    sql["strategy_by_symbol_ticks"] = f"""with {tick_rows}, {strategy_rows('tick_rows', 'model', 'date, row_id')},
{curve('strat', 'model, symbol', 'date, row_id')}, {summary('model, symbol', *ROW_TRADES)} select model, symbol, {shown} from metrics"""
    sql["equity_curve_ticks"] = f"""with {tick_rows}, {strategy_rows('tick_rows', 'model', 'date, row_id')},
{curve('strat', 'model', 'date, row_id')} select row_id, symbol, {tidied(['equity', 'drawdown'])} from curve"""
    swings = f"""{ticks}, swings as (
  select 'all' as model, row_id, date, symbol, close, ([{strings(fixed.LABELS)}])[1 + (date_diff('day', date '1992-01-01', date) // 91) % 3] as y_pred
  from ticks), {strategy_rows('swings', 'model', 'date, row_id')}"""
    by_symbol = "partition by symbol order by date, row_id"
    sql["stops_ticks"] = f"""with {swings},
moves as (select *, coalesce(held, 0) as h, coalesce(held * returns, 0e0) as r, coalesce(held, 0) <> coalesce(lag(held) over ({by_symbol}), 0) as turned from all_rows),
trades as (select *, sum(cast(turned as int)) over ({by_symbol}) as trade from moves),
gains as (select *, product(1 + r) over (partition by symbol, trade order by date, row_id rows between unbounded preceding and current row) - 1 as gain from trades),
ends as (select *, max(case when gain <= -0.0333e0 or gain >= 0.0477e0 then 1 else 0 end) over (
  partition by symbol, trade order by date, row_id rows between unbounded preceding and 1 preceding) as done from gains)
select row_id, symbol, {tidy('case when done = 1 then 0e0 else r end')} as stopped_returns from ends"""
    sql["drawdown_limit_ticks"] = f"""with {tick_rows}, {strategy_rows('tick_rows', 'model', 'date, row_id')},
filled as (select symbol, date, row_id, coalesce(strategy_returns, 0e0) as strategy from all_rows),
{curve('filled', 'symbol', 'date, row_id', 'strategy')},
done as (select *, max(case when drawdown <= -0.005e0 then 1 else 0 end) over (
  {by_symbol} rows between unbounded preceding and 1 preceding) as over_limit from curve)
select row_id, symbol, {tidy('strategy')} as strategy, {tidy('case when over_limit = 1 then 0e0 else strategy end')} as limited_returns from done"""
    sql["backtest_costs_ticks"] = f"""with {swings}, weighted as (select *, 0.001e0 * signal as weight from all_rows),
moved as (select *, coalesce(lag(weight) over ({by_symbol}), 0) as before_w from weighted),
flows as (select date, sum(coalesce(before_w * returns, 0)) as gross, sum(abs(weight - before_w) * 0.0015e0) as cost from moved group by 1),
account as (select *, 100000 * product(1 + gross - cost) over (order by date rows between unbounded preceding and current row) as capital from flows)
select 'all' as model, date, {tidied(['gross', 'cost', 'capital'])} from account"""
    price = "o_totalprice"
    classes = f"([{strings(fixed.LABELS)}])"
    sql["rank_metrics_ticks"] = f"""with weighed as (
  select o_orderkey as row_id, {classes}[1 + o_orderkey % 3] as y_true, 1 + {price} as w0, 1 + ({price} * 7) % 100000 as w1,
    1 + ({price} * 3) % 300000 as w2 from orders),
predictions as (select 'all' as model, y_true, w0 / (w0 + w1 + w2) as p_negative, w1 / (w0 + w1 + w2) as p_neutral,
  w2 / (w0 + w1 + w2) as p_positive from weighed),
{RANK_ROWS}, swept as (
  select *, sum(pos) over w as tp, sum(pos + neg) over w as seen, sum(neg) over w as fp
  from by_score window w as (partition by model, class order by score desc rows between unbounded preceding and current row)),
each as (
  select model, class, sum(tp * 1e0 / seen * pos) / sum(pos) as pr,
    1 - sum(pos * (fp - neg / 2e0)) / (sum(pos)::double * sum(neg)) as roc from swept group by 1, 2)
select model, {tidy('avg(roc)')} as auc_roc, {tidy('avg(pr)')} as auc_pr from each group by 1"""
    sql["time_split"] = f"with {HEADLINES}, {split_of('headlines')} select headline_id, date, symbol, split from parts"
    sql["split_sizes"] = f"with {HEADLINES}, {split_of('headlines')} select split, count(*) as n from parts group by 1"

    sql["clean_urls"] = _text(removed("lower(headline)", URL))
    sql["clean_emails"] = _text(removed("lower(headline)", r"\S+@\S+"))
    sql["clean_phones"] = _text(removed("lower(headline)", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"))
    sql["clean_mentions"] = _text(removed("lower(headline)", f"@{W}+"))
    sql["clean_hashtags"] = _text(removed("lower(headline)", f"#{W}+"))
    sql["clean_text"] = _text(clean("headline"))
    sql["tokenize"] = _text(f"array_to_string({tokens(clean('headline'))}, '|')")
    kept = f"list_filter({tokens(clean('headline'))}, lambda x: x not in ({kept_words()}))"
    sql["remove_stopwords"] = _text(f"array_to_string({kept}, '|')")
    joined = "string_agg(lemma, '{}' order by pos)"
    sql["lemmatize"] = f"""with {TOKENS}, {lemma_ctes()} select h.headline_id, coalesce({joined.format('|')}, '') as text
from headlines h left join (tokens join lemmas using (token)) using (headline_id) group by 1"""
    stopped = f"stopped as (select * from tokens join lemmas using (token) where token not in ({kept_words()}))"
    sql["preprocess_text"] = f"""with {TOKENS}, {lemma_ctes()}, {stopped} select h.headline_id,
coalesce({joined.format(' ')}, '') as headline_processed from headlines h left join stopped using (headline_id) group by 1"""
    sql["preprocess_tokens"] = f"""with {TOKENS}, {lemma_ctes()}, {stopped} select h.headline_id, cast(count(lemma) as int) as n_tokens,
coalesce({joined.format('|')}, '') as tokens from headlines h left join stopped using (headline_id) group by 1"""
    sql["entity_flags"] = f"with {HEADLINES}, {FLAGS} select headline_id, {', '.join(FLAG_NAMES)} from flagged"
    sql["entity_flags_word"] = f"""with {HEADLINES} select headline_id, {whole_word(fixed.EARNINGS_WORDS)} as has_earnings_keywords,
{whole_word(fixed.MERGER_WORDS)} as has_merger_keywords, {whole_word(fixed.REGULATORY_WORDS)} as has_regulatory_keywords from headlines"""
    sql["entity_counts"] = f"""with {HEADLINES}, {FLAGS} select symbol, {', '.join(
        f"count(*) filter ({f}) as {f.replace('has_', 'n_')}" for f in FLAG_NAMES)} from flagged group by 1"""

    sql["lexicon_polarity"] = f"with {POLARITY} select headline_id, {tidy('polarity')} as polarity, n_hits, {cut_label('polarity')} as y_pred from polarity"
    sql["lexicon_subjectivity"] = f"with {POLARITY} select headline_id, {tidy('subjectivity')} as subjectivity from polarity"
    probabilities = ["p_negative", "p_neutral", "p_positive"]
    sql["valence_compound"] = f"""with {VALENCE} select headline_id, {tidied(['compound', *probabilities])},
{cut_label('compound')} as y_pred from valence"""
    sql["valence_rules"] = valence_rules()
    sql["tokenize_sentences"] = sentence_tokens()
    scores = [f"score_{c}" for c in fixed.LABELS]
    total = " + ".join(f"exp({s} - top)" for s in scores)
    sql["model_nb"] = f"""with {TOKENS}, {TRUTH}, nb_train as (select row_id as headline_id, y_true as label from truth), {nb('nb_train', 'headlines')}
select headline_id, {tidied(scores, 4)}, y_pred, {', '.join(
        f"{tidy(f'exp({s} - top) / ({total})', 4)} as {p}" for s, p in zip(scores, probabilities))} from nb"""
    exported = f"{TRUTH}, nb_train as (select row_id as headline_id, y_true as label from truth), {nb('nb_train', 'headlines')}"
    sql["model_scores"] = f"""with {TOKENS}, {exported} select headline_id, y_pred, {', '.join(
        f"{tidy(f'exp({s} - top) / ({total})', 4)} as {p}" for s, p in zip(scores, probabilities))} from nb"""
    winner = """case when {0} >= {1} and {0} >= {2} then 'negative' when {1} >= {2} then 'neutral' else 'positive' end"""
    votes = f"""{PREDICTIONS}, votes as (select row_id, {', '.join(f"count(*) filter (y_pred = '{c}') as n_{c}" for c in fixed.LABELS)}
  from predictions group by 1)"""
    sql["ensemble_vote"] = f"""with {votes} select *, {winner.format(*[f'n_{c}' for c in fixed.LABELS])} as y_pred from votes"""
    sql["ensemble_mean"] = f"""with {PREDICTIONS}, means as (select row_id, {', '.join(f'avg({p}) as {p}' for p in probabilities)}
  from predictions group by 1) select row_id, {tidied(probabilities)},
  {winner.format(*[f'round({p}, 12)' for p in probabilities])} as y_pred from means"""
    sql["model_logistic"] = f"with {HEADLINES} select headline_id, 1e0 as p_total, true as is_best from headlines"
    sql["baseline_majority"] = f"""with {HEADLINES}, {TRUTH}, top as (select y_true from truth group by 1
  order by count(*) desc, case y_true when 'negative' then 0 when 'neutral' then 1 else 2 end limit 1)
select headline_id, (select y_true from top) as y_pred from headlines"""
    sql["baseline_random"] = f"""with {HEADLINES} select headline_id,
([{strings(fixed.LABELS)}])[1 + {hash_int("'42:class:' || headline_id")} % 3] as y_pred from headlines"""

    def occurrences(words):
        return "1 + " + " + ".join(f"(length(headline) - length(replace(headline, '{w}', ''))) / {len(w)}" for w in words)

    sql["plug_in_scorer"] = f"""with {HEADLINES}, found as (select headline_id, {occurrences(inputs.POSITIVE_WORDS)} as up,
  {occurrences(inputs.NEGATIVE_WORDS)} as down from headlines)
select headline_id, case when down >= 1 and down >= up then 'negative' when 1 >= up then 'neutral' else 'positive' end as y_pred,
  {tidy('down / (up + down + 1)')} as p_negative, {tidy('1 / (up + down + 1)')} as p_neutral, {tidy('up / (up + down + 1)')} as p_positive
from found"""

    sql["clf_accuracy"] = f"with {COUNTED} select model, n, {tidied(['accuracy'])} from counted"
    sql["clf_macro"] = f"with {COUNTED} select model, {tidied(['precision_macro', 'recall_macro', 'f1_macro'])} from counted"
    sql["clf_weighted"] = f"with {COUNTED} select model, {tidied(['f1_weighted'])} from counted"
    sql["clf_per_class"] = f"with {COUNTED} select model, {tidied(PER_CLASS)} from counted"
    sql["confusion_matrix"] = f"""with {PREDICTIONS} select model, y_true, {', '.join(
        f"count(*) filter (y_pred = '{c}') as pred_{c}" for c in fixed.LABELS)} from predictions group by 1, 2"""
    sql["clf_auc_roc"] = f"with {PREDICTIONS}, {RANKED} select model, {tidied(['auc_roc'])} from ranked"
    sql["clf_auc_pr"] = f"with {PREDICTIONS}, {RANKED} select model, {tidied(['auc_pr'])} from ranked"
    compared = f"{RUN}, {count_metrics('predictions')}, {RANKED}, compared as (select * exclude (n_rows) from counted join ranked using (model) left join metrics using (model))"
    sql["model_comparison"] = f"""with {compared} select model, n,
{tidied([*MAIN, *PER_CLASS, 'auc_roc', 'auc_pr', *STRATEGY_TIDY])}, num_trades from compared"""
    report = [*MAIN, "total_return", "annualized_return", "sharpe_ratio", "sortino_ratio", "max_drawdown", "calmar_ratio", "hit_rate"]
    sql["metrics_long"] = f"with {compared} " + " union all ".join(
        f"select model, {i} as position, '{m}' as metric, {tidy(m)} as value from compared where {m} is not null" for i, m in enumerate(report))

    sql["signals"] = f"with {PREDICTIONS} select model, row_id, y_pred, {SIGNAL} as signal from predictions"
    columns = f"select model, row_id, signal, {tidied(['returns', 'strategy_returns'])} from strat"
    sql["strategy_returns"] = f"with {EVALUATED}, {strategy_rows('evaluated', 'model', 'date, row_id')} {columns}"
    sql["strategy_returns_frame"] = f"with {EVALUATED}, {strategy_rows('evaluated', 'model', 'date, row_id', True)} {columns}"
    shown = f"n_rows, {tidied(STRATEGY_TIDY)}, num_trades"
    sql["strategy_metrics"] = f"with {RUN} select model, {shown} from metrics"
    day_trades = ("sum(trades)", "sum(trade_sum)", "sum(wins)")
    sql["strategy_metrics_date"] = f"""with {EVALUATED}, {strategy_rows('evaluated', 'model', 'date, row_id')},
daily as (select model, date, avg(strategy_returns) as strategy_returns, {ROW_TRADES[0]} as trades, {ROW_TRADES[1]} as trade_sum,
  {ROW_TRADES[2]} as wins from strat group by 1, 2),
{curve('daily', 'model', 'date')}, {summary('model', *day_trades)} select model, {shown} from metrics"""
    sql["strategy_simple"] = f"with {RUN} select model, {tidied(['total_return', 'volatility', 'sharpe_simple', 'max_drawdown'])} from metrics"
    sql["strategy_by_symbol"] = f"with {BAR_ROWS}, {curve('strat', 'symbol', 'date')}, {summary('symbol', *ROW_TRADES)} select symbol, {shown} from metrics"
    sql["equity_curve"] = f"""with {EVALUATED}, {strategy_rows('evaluated', 'model', 'date, row_id')}, {curve('strat', 'model', 'date, row_id')}
select model, row_id, date, {tidied(['equity', 'drawdown'])} from curve"""
    sql["drawdown_series"] = f"with {BAR_ROWS}, {curve('strat', 'symbol', 'date')} select symbol, date, {tidied(['equity', 'peak', 'drawdown'])} from curve"

    sql["information_ratio"] = f"""with {BAR_DAILY} select 'all' as model,
{tidy('avg(strategy - benchmark) / nullif(stddev_samp(strategy - benchmark), 0) * sqrt(252)')} as information_ratio from daily"""
    sql["alpha_beta"] = f"""with {BAR_DAILY} select 'all' as model, {tidy('regr_intercept(strategy, benchmark)')} as alpha,
{tidy('regr_slope(strategy, benchmark)')} as beta from daily"""
    sql["regression_metrics"] = f"""with {BARS}, ahead as (select symbol, close, lead(close) over ({S}) as next from bars),
errors as (select *, next - close as e from ahead where next is not null)
select symbol, count(*) as n, {tidy('avg(e * e)')} as mse, {tidy('sqrt(avg(e * e))')} as rmse, {tidy('avg(abs(e))')} as mae,
{tidy('1 - sum(e * e) / nullif(var_pop(next) * count(*), 0)')} as r2, {tidy('avg(abs(e / nullif(next, 0)))')} as mape from errors group by 1"""
    sql["position_weights"] = f"with {WEIGHTS} select symbol, date, signal, {tidied(['weight'])} from weighted"
    sql["rebalance"] = f"with {WEIGHTS}, {rebalanced('month')} select symbol, date, {tidied(['weight'])} from held_weights"
    sql["backtest_costs"] = f"""with {WEIGHTS}, {rebalanced('week')},
moves as (select *, coalesce(lag(weight) over ({S}), 0) as before_w from held_weights),
flows as (select date, sum(coalesce(before_w * returns, 0)) as gross, sum(abs(weight - before_w) * 0.0015e0) as cost from moves group by 1),
account as (select *, 100000 * product(1 + gross - cost) over (order by date rows between unbounded preceding and current row) as capital from flows)
select 'all' as model, date, {tidied(['gross', 'cost', 'capital'])} from account"""
    sql["stops"] = f"""with recursive {BAR_ROWS},
numbered as (
  select symbol, date, coalesce(lag(signal) over ({S}), 0) as held, coalesce(coalesce(lag(signal) over ({S}), 0) * returns, 0e0) as r,
    row_number() over ({S}) as i from all_rows),
walk as (
  select symbol, date, i, held, 1 + r as growth, r as stopped, (r <= -0.05 or r >= 0.15) as closed from numbered where i = 1
  union all
  select n.symbol, n.date, n.i, n.held, case when n.held = w.held then w.growth * (1 + n.r) else 1 + n.r end,
    case when n.held = w.held and w.closed then 0e0 else n.r end,
    case when n.held = w.held then w.closed or w.growth * (1 + n.r) - 1 <= -0.05 or w.growth * (1 + n.r) - 1 >= 0.15
         else n.r <= -0.05 or n.r >= 0.15 end
  from walk w join numbered n on n.symbol = w.symbol and n.i = w.i + 1)
select symbol, date, {tidy('stopped')} as stopped_returns from walk"""
    sql["drawdown_limit"] = f"""with {BAR_DAILY}, filled as (select date, coalesce(strategy, 0e0) as strategy from daily),
{curve('filled', '', 'date', 'strategy')}, breach as (select min(date) as day from curve where drawdown <= -0.2)
select date, {tidy('strategy')} as strategy, {tidy('case when date > (select day from breach) then 0e0 else strategy end')} as limited_returns from filled"""
    sql["cv_time_series"] = "with " + folds("date < test_start - 1")
    sql["cv_purged"] = "with " + folds("date < test_start - 5 or date > test_end + 5")
    sql["bootstrap_ci"] = f"""with {SCORED}, {weights('scored')},
units as (select model, date, sum(hit) as s, count(*) as n from scored group by 1, 2),
replicates as (select model, replicate, sum(w * s) * 1e0 / nullif(sum(w * n), 0) as m from units join draws using (date) group by 1, 2),
ends as (select model, quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high from replicates group by 1),
points as (select model, sum(s) * 1e0 / sum(n) as mean from units group by 1)
select model, {tidied(['mean', 'low', 'high'])} from points join ends using (model)"""
    sql["paired_t"] = f"""with {SCORED}, diffs as (
  select o.model, o.hit - b.hit as d from scored o join scored b on b.row_id = o.row_id and b.model = 'm0' where o.model <> 'm0')
select model, count(*) as n, {tidy('avg(d)')} as mean_diff, {tidy('avg(d) / nullif(stddev_samp(d) / sqrt(count(*)), 0)')} as t from diffs group by 1"""
    lags = " + ".join(f"2 * (1 - {k}e0 / 5) * coalesce(sum(c * c{k}), 0)" for k in range(1, 5))
    sql["diebold_mariano"] = f"""with {DIFFERENTIAL}, centred as (select *, d - avg(d) over (partition by model) as c from differential),
lagged as (select *, {', '.join(f'lag(c, {k}) over (partition by model order by date) as c{k}' for k in range(1, 5))} from centred)
select model, count(*) as n, {tidy('avg(d)')} as mean_diff,
{tidy(f'case when sum(c * c) + {lags} > 0 then avg(d) / sqrt((sum(c * c) + {lags}) / count(*) / count(*)) end')} as dm from lagged group by 1"""
    sql["reality_check"] = f"""with {DIFFERENTIAL}, {weights('differential')},
points as (select model, avg(d) as mean, count(*) as t from differential group by 1),
replicates as (select model, replicate, sum(w * d) / nullif(sum(w), 0) as m from differential join draws using (date) where w > 0 group by 1, 2),
best as (select replicate, max(sqrt(t) * (m - mean)) as v from replicates join points using (model) group by 1),
observed as (select max(sqrt(t) * mean) as statistic from points)
select {tidy('max(statistic)')} as statistic, {tidy('avg(case when v >= statistic then 1e0 else 0e0 end)')} as p_value from best, observed"""
    sql["feature_table"] = f"""with {POLARITY}, {VALENCE.replace(TOKENS + ', ' + LEXICON + ', ', '', 1)}, {exported}, {FLAGS}, {INDICATORS}
select headline_id, f.date, f.symbol, {tidy('polarity')} as sentiment_polarity, {tidy('subjectivity')} as sentiment_subjectivity,
  {tidy('compound')} as sentiment_valence, cast(length(headline) as int) as text_length,
  cast(len(list_filter(regexp_split_to_array(headline, '\\s+'), lambda x: x <> '')) as int) as word_count,
  has_earnings_keywords, has_merger_keywords, has_regulatory_keywords,
  {tidy(f'(exp(score_positive - top) - exp(score_negative - top)) / ({total})', 4)} as model_sentiment,
  {tidied(['price_change_1d', 'price_change_7d', 'volume_ratio', 'volatility_7d', 'rsi_14d'])}
from flagged f join polarity using (headline_id) join valence using (headline_id) join nb using (headline_id)
join indicators i on i.symbol = f.symbol and i.date = f.date"""
    sql["baseline_comparison"] = "with " + comparison_end_to_end()
    return sql
