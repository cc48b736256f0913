"""Content safety: category severities, labels, thresholds, audit rows,
prompt-attack rules, groundedness, blocklists, protected material.

Severities follow the 0/2/4/6 scale of the four-category model (hate,
self_harm, sexual, violence). The scorer here is an offline lexicon; any
remote or learned scorer can replace it by producing the same four INT
columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.plans.sizing import broadcast_if_bounded, materialize

CATEGORIES = ("hate", "self_harm", "sexual", "violence")

# Offline default lexicon (category -> terms, each of weight 1),
# everyday words of the four categories in English, German, Spanish and French.
LEXICON_TERMS = {
    "hate": ["idiot", "moron", "scum", "clown", "loser", "stupid", "worthless", "pathetic", "trash", "disgusting",
             "idiota", "imbécil", "estúpido", "basura", "escoria", "dummkopf", "abschaum", "dumm", "widerlich",
             "imbécile", "stupide", "ordure", "racaille", "dégoûtant"],
    "self_harm": ["suicide", "suicidal", "suicidio", "selbstmord", "suizid", "suicidaire"],
    "sexual": ["porn", "pornography", "nude", "naked", "pornografía", "desnudo", "pornografie", "nackt",
               "pornographie", "nu"],
    "violence": ["kill", "murder", "stab", "shoot", "bomb", "matar", "asesinar", "bomba", "töten", "ermorden", "bombe",
                 "tuer", "assassiner", "poignarder"],
}
DEFAULT_LEXICON = {term: (category, 1.0) for category, terms in LEXICON_TERMS.items() for term in terms}

# Weighted-hit cut points for severities 2, 4 and 6.
SEVERITY_CUTS = (1.0, 3.0, 6.0)

# Default per-category filter threshold and groundedness
# threshold (service configuration defaults).
DEFAULT_THRESHOLDS = {"hate": 2, "self_harm": 2, "sexual": 2, "violence": 2}
GROUNDEDNESS_THRESHOLD = 0.7

# Prompt-attack rules (case-insensitive, RE2-compatible).
JAILBREAK_PATTERNS = (
    r"ignore (all |any )?(the )?(previous|prior|above) (instructions|rules)",
    r"disregard (the |your |all )?(system|previous|prior) (prompt|instructions)",
    r"you are now (dan|in developer mode)",
    r"pretend (you are|to be) [a-z ]* without (any )?(restrictions|rules|filters)",
    r"reveal (your|the) (system prompt|hidden instructions)",
)

# Maximum characters sent to one severity call (documented service limit).
SEGMENT_CHARS = 10_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _bucket(score: Column) -> Column:
    lo, mid, hi = SEVERITY_CUTS
    return (F.when(score >= hi, 6).when(score >= mid, 4).when(score >= lo, 2).otherwise(0)).cast("int")


def lexicon_score(tokens: Column, lexicon: dict, category: str) -> Column:
    """Weighted count of lexicon hits of one category in a token array
    (row-local; the lexicon is a small fixed literal)."""
    terms = {t: w for t, (c, w) in lexicon.items() if c == category}
    if not terms:
        return F.lit(0.0)
    by_w: dict[float, list[str]] = {}
    for t, w in terms.items():
        by_w.setdefault(w, []).append(t)
    def member(ts):
        return lambda x: x.isin(*sorted(ts))

    total = F.lit(0.0)
    for w, ts in sorted(by_w.items()):
        total = total + F.lit(w) * F.size(F.filter(tokens, member(ts)))
    return total


def severity_from_tokens(tokens: Column, lexicon: dict | None = None) -> list[Column]:
    """C1 offline scorer on a token array: four INT severity columns (hate,
    self_harm, sexual, violence), lexicon hits per category bucketed to
    0/2/4/6. Absent categories are 0. Row-local, no shuffle."""
    lex = lexicon or DEFAULT_LEXICON
    return [_bucket(lexicon_score(tokens, lex, c)).alias(c) for c in CATEGORIES]


def severity_lexicon(df: DataFrame, text_col: str = "text", keep=("doc_id",),
                     lexicon: dict | None = None) -> DataFrame:
    """(keep..., hate, self_harm, sexual, violence) per row."""
    staged = df.select(*keep, T.words(text_col).alias("__toks"))
    return staged.select(*keep, *severity_from_tokens(F.col("__toks"), lexicon))


def severity_from_lexicon_table(df: DataFrame, lexicon: DataFrame, text_col: str = "text",
                                key: str = "doc_id") -> DataFrame:
    """C1 for a large lexicon given as a table (term, category, weight):
    tokens joined to the (size-checked, broadcast) lexicon, summed per
    (row, category) with a map-side combine, pivoted to the four columns."""
    occ = T.explode_tokens(df, [key], T.words(text_col))
    hits = (occ.join(broadcast_if_bounded(lexicon), "term")
            .groupBy(key).pivot("category", list(CATEGORIES)).agg(F.sum("weight")))
    out = df.select(key).join(hits, key, "left")
    return out.select(key, *[_bucket(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in CATEGORIES])


def severity_label(sev: Column | str) -> Column:
    """0 safe, <=2 low, <=4 medium, else high."""
    s = _c(sev)
    return (F.when(s == 0, "safe").when(s <= 2, "low").when(s <= 4, "medium").otherwise("high"))


def threshold_filter(df: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """C4: per-category ``<cat>_filtered = severity >= threshold``."""
    th = {**DEFAULT_THRESHOLDS, **(thresholds or {})}
    return df.select("*", *[(F.col(c) >= F.lit(th[c])).alias(f"{c}_filtered") for c in CATEGORIES])


def audit(df: DataFrame, jailbreak: Column | None = None, indirect: Column | None = None,
          grounded: Column | None = None, ground_score: Column | None = None,
          keep=("doc_id",)) -> DataFrame:
    """The 11-field audit row from four severities plus flags.

    is_safe needs all severities 0 and no attack flag (thresholds and
    groundedness do not enter); categories_triggered lists categories with
    severity > 0 in fixed order, then jailbreak, indirect_attack.
    """
    jb = F.coalesce(jailbreak, F.lit(False)) if jailbreak is not None else F.lit(False)
    ia = F.coalesce(indirect, F.lit(False)) if indirect is not None else F.lit(False)
    g = grounded if grounded is not None else F.lit(True)
    gs = ground_score if ground_score is not None else F.lit(1.0)
    sev = [F.coalesce(F.col(c), F.lit(0)) for c in CATEGORIES]
    all_zero = sev[0] == 0
    for s in sev[1:]:
        all_zero = all_zero & (s == 0)
    trig = F.array_compact(F.array(*[F.when(s > 0, F.lit(c)) for s, c in zip(sev, CATEGORIES)],
                                   F.when(jb, F.lit("jailbreak")), F.when(ia, F.lit("indirect_attack"))))
    return df.select(
        *keep,
        (all_zero & ~jb & ~ia).alias("is_safe"),
        F.greatest(*sev).alias("max_severity"),
        trig.alias("categories_triggered"),
        *[s.alias(f"{c}_severity") for s, c in zip(sev, CATEGORIES)],
        jb.alias("jailbreak_detected"),
        ia.alias("indirect_attack_detected"),
        g.alias("is_grounded"),
        gs.cast("double").alias("groundedness_score"),
    )


def attack_flag(text: Column | str, patterns=JAILBREAK_PATTERNS) -> Column:
    """True when any attack rule matches (case-insensitive)."""
    t = F.lower(_c(text))
    flag = F.lit(False)
    for p in patterns:
        flag = flag | F.coalesce(t.rlike(p), F.lit(False))
    return flag


def prompt_shield(prompts: DataFrame, retrieved: DataFrame | None = None,
                  key: str = "query_id", prompt_col: str = "query",
                  doc_text_col: str = "text") -> DataFrame:
    """User-prompt attack per prompt; document attack when any retrieved
    document of the prompt matches (a per-hit flag reduced with bool_or, so
    no document list is ever gathered). attack_types: "jailbreak" then at
    most one "indirect_injection"."""
    up = prompts.select(key, attack_flag(prompt_col).alias("user_prompt_attack"))
    if retrieved is not None:
        da = (retrieved.select(key, attack_flag(doc_text_col).alias("a"))
              .groupBy(key).agg(F.bool_or("a").alias("document_attack")))
        up = up.join(da, key, "left")
    else:
        up = up.withColumn("document_attack", F.lit(None).cast("boolean"))
    doc = F.coalesce(F.col("document_attack"), F.lit(False))
    return up.select(key, "user_prompt_attack", doc.alias("document_attack"),
                     F.array_compact(F.array(F.when(F.col("user_prompt_attack"), F.lit("jailbreak")),
                                             F.when(doc, F.lit("indirect_injection")))).alias("attack_types"))


def groundedness(answer: Column | str, sources_text: Column | str,
                 threshold: float | None = None, min_cover: float = 0.6) -> tuple[Column, Column]:
    """C10 offline scorer: share of answer sentences whose distinct words are
    at least ``min_cover`` covered by the grounding text. Returns (score,
    is_grounded). No sentence, no sources, or a scorer failure fails open:
    (1.0, True), as the service path does."""
    th = GROUNDEDNESS_THRESHOLD if threshold is None else threshold
    src = F.array_distinct(T.words(sources_text))
    sents = T.sentences(answer)
    cov = F.transform(sents, lambda s: T.coverage(T.words(s), src))
    n = F.size(F.filter(cov, lambda c: c >= min_cover)).cast("double")
    raw = F.try_divide(n, F.size(cov).cast("double"))
    ok = raw.isNotNull() & (F.size(src) > 0)
    score = F.when(ok, F.round(raw, 6)).otherwise(F.lit(1.0))
    verdict = F.when(ok, raw >= 0.5).otherwise(F.lit(True))
    return score, (verdict & (score >= F.lit(th)))


#: Terms and bytes of a blocklist that one automaton holds, about; it takes some
#: hundred bytes a character.
AUTOMATON_TERMS = 50_000
AUTOMATON_BYTES = 1 << 20


def blocklist_match(df: DataFrame, blocklist: DataFrame, key: str = "doc_id", text_col: str = "text",
                    block_terms: int = AUTOMATON_TERMS, block_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """One row per (row, list, term, position) where a blocklist entry
    (list_name, term) occurs: its words stand consecutively, from word ``pos``.
    Overlapping and nested occurrences all count; an entry given twice is found
    twice. NULL texts and terms without a word match nothing.

    The distinct terms are measured and dealt by hash into blocks of about
    ``block_terms`` and ``block_bytes``; a block passes the driver and becomes one
    Aho-Corasick automaton in the tasks, which reads a text once whatever the
    terms' lengths. So no n-grams are built, a usual list takes one scan, and a
    list of any size one scan a block."""
    bl = blocklist.select("list_name", F.array_join(T.words("term"), " ").alias("term")).filter(F.length("term") > 0)
    terms = bl.select("term").distinct()
    size = terms.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-size["n"] // block_terms), -(-size["b"] // block_bytes))
    toks = df.select(F.col(key).cast("string").alias("__key"), F.array_join(T.words(text_col), " ").alias("__toks")).filter(F.length("__toks") > 0)
    hits = None
    for i in range(blocks):
        block = [r["term"] for r in terms.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == i).collect()]
        shipped = df.sparkSession.sparkContext.broadcast(block)
        found = toks.mapInPandas(_automaton_scan(shipped), "__key string, term string, pos int")
        hits = found if hits is None else hits.unionByName(found)
    return hits.join(broadcast_if_bounded(bl), "term").select(
        F.col("__key").cast(df.schema[key].dataType).alias(key), "list_name", "term", "pos")


def _automaton_scan(shipped):
    """mapInPandas body: (key, space-joined words) to (key, term, word position)
    of every occurrence of the shipped terms. Keys come as text, since pandas turns
    whole numbers beside nulls into floats. Words are parted by single spaces
    and hold none, so a term between spaces is found at whole words only."""
    def scan(batches):
        from bisect import bisect_left
        from itertools import accumulate

        import ahocorasick
        import pandas as pd

        automaton = ahocorasick.Automaton()
        for term in shipped.value:
            automaton.add_word(f" {term} ", term)
        if not len(automaton):
            return
        automaton.make_automaton()
        for pdf in batches:
            keys, terms, at = [], [], []
            for key, toks in zip(pdf["__key"], pdf["__toks"]):
                spaces = None
                for end, term in automaton.iter(f" {toks} "):
                    if spaces is None:   # where each word's leading space stands
                        spaces = [0, *accumulate(len(w) + 1 for w in toks.split(" "))]
                    keys.append(key)
                    terms.append(term)
                    at.append(bisect_left(spaces, end - len(term) - 1))
            if keys:
                yield pd.DataFrame({"__key": keys, "term": terms, "pos": at})

    return scan


#: Text bytes that are tokens and hashes at a time in a shingle scan.
SCAN_BYTES = 1 << 20


def _shingle_scan(n: int, prot_hashes=None):
    """mapInArrow body: for each slice of about ``SCAN_BYTES`` of (key, space-joined tokens), hash every
    token once (pandas' C hash, deterministic), combine n consecutive token
    hashes with a polynomial rolling hash (numpy, wrapping uint64), drop
    windows that cross a document boundary, and, when ``prot_hashes`` is
    given, keep only windows whose hash is in that sorted set. Emits (key,
    pos, h, s) with s the shingle text, built only for kept windows. So a task
    holds the tokens of one slice, whatever the batch's rows and lengths are
    (a longer text is a slice of its own)."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa
    import pyarrow.compute as pc

    mult = np.uint64(1099511628211)

    def slices(batch):
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(size):
            before = size[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, before + SCAN_BYTES, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi

    def scan(part):
        # Tokens arrive space-joined (they never contain spaces): a plain
        # string crosses Arrow far faster than an array of strings.
        toks = [t.split(" ") if t else [] for t in part.column(1).to_pylist()]
        lens = np.fromiter((len(t) for t in toks), dtype=np.int64, count=len(toks))
        total = int(lens.sum())
        if total < n:
            return None
        flat = np.concatenate([np.asarray(t, dtype=object) for t in toks if len(t)])
        th = pd.util.hash_array(flat, categorize=False)
        m = total - n + 1
        h = np.zeros(m, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(n):
                h = h * mult + th[j:j + m]
        doc = np.repeat(np.arange(len(lens)), lens)[:m]
        pos = (np.arange(total) - np.repeat(np.cumsum(lens) - lens, lens))[:m]
        keep = pos + n <= lens[doc]
        if prot_hashes is not None and len(prot_hashes):
            i = np.clip(np.searchsorted(prot_hashes, h), 0, len(prot_hashes) - 1)
            keep &= prot_hashes[i] == h
        elif prot_hashes is not None:
            return None
        idx = np.nonzero(keep)[0]
        if len(idx) == 0:
            return None
        text = [" ".join(flat[k:k + n]) for k in idx]
        return pa.RecordBatch.from_arrays(
            [part.column(0).take(pa.array(doc[idx])), pa.array(pos[idx].astype(np.int32)),
             pa.array(h[idx].view(np.int64)), pa.array(text, type=pa.string())], names=[part.schema.names[0], "pos", "h", "s"])

    def fn(batches):
        for batch in batches:
            for part in slices(batch):
                found = scan(part)
                if found is not None:
                    yield found

    return fn


# Protected shingles that go to every task as one sorted hash array (8 bytes
# each, about: at most 64 MB per executor).
PROTECTED_BLOCK = 8_000_000


def protected_material(docs: DataFrame, protected: DataFrame, n: int = 8,
                       key: str = "doc_id", item: str = "item_id", block: int = PROTECTED_BLOCK) -> DataFrame:
    """C14: n-token shingles of protected passages matched in documents.

    Output per (doc, item): distinct matched shingles, the item's distinct
    shingles, and their ratio. Tokens are built JVM-side. The protected
    side's shingles (hash and text) come from the same scan. Their distinct
    hashes are dealt into blocks of about ``block`` by value; a block passes the
    driver as one Arrow column, is sorted and broadcast, and each document batch keeps only
    positions whose rolling hash is in it, so shingle text is built for
    candidates only. One block takes one scan of the documents, more take one
    each. Candidates are then joined on hash and confirmed on text, which makes
    the result exact.
    """
    import numpy as np

    def toks(df, k):
        return df.select(F.col(k), F.array_join(T.words("text"), " ").alias("__toks"))

    def kind(df, k):
        return f"`{k}` {df.schema[k].dataType.simpleString()}, pos int, h long, s string"

    # Written once: counted, collected as hashes, joined and sized from there.
    prot = materialize(toks(protected, item).mapInArrow(_shingle_scan(n), kind(protected, item))
                       .select(item, "h", F.col("s").alias("ps")).distinct(), "protected")
    sizes = prot.groupBy(item).agg(F.count(F.lit(1)).alias("item_shingles"))
    distinct = prot.select("h").distinct()
    blocks = max(1, -(-distinct.count() // block))
    cand = None
    for i in range(blocks):
        part = distinct.filter(F.pmod(F.xxhash64("h"), F.lit(blocks)) == i).toArrow()["h"].to_numpy()
        bc = docs.sparkSession.sparkContext.broadcast(np.sort(part.astype(np.int64).view(np.uint64)))

        def scan(batches, bc=bc):
            return _shingle_scan(n, bc.value)(batches)

        found = toks(docs, key).mapInArrow(scan, kind(docs, key)).select(key, "h", "s")
        cand = found if cand is None else cand.unionByName(found)
    hits = (cand.join(broadcast_if_bounded(prot), "h")
            .filter(F.col("s") == F.col("ps"))
            .select(key, item, "s").distinct()
            .groupBy(key, item).agg(F.count(F.lit(1)).alias("matched")))
    return (hits.join(broadcast_if_bounded(sizes), item)
            .select(key, item, "matched", "item_shingles",
                    F.round(F.col("matched") / F.col("item_shingles"), 6).alias("overlap")))


def segment_max_severity(df: DataFrame, text_col: str = "text", keep=("doc_id",),
                         seg_chars: int = SEGMENT_CHARS, lexicon: dict | None = None) -> DataFrame:
    """Split text into segments of about seg_chars characters, score
    each, keep the max severity per category. Row-local: segments never leave
    their row. A word that stands across an edge belongs to the segment it
    begins in: that segment is read on by one character more than the longest
    term (a longer word is no term), and the next one starts after the word."""
    lex = lexicon or DEFAULT_LEXICON
    more = max((len(t) for t in lex), default=0) + 1
    t = F.coalesce(_c(text_col), F.lit(""))
    nseg = F.greatest(F.lit(1), F.ceil(F.length(t) / F.lit(seg_chars)).cast("int"))
    word = T.WORD_PATTERN

    def segment(i):
        body = F.substr(t, i * seg_chars + 1, F.lit(seg_chars))
        inside = (i > 0) & F.substr(t, i * seg_chars, F.lit(1)).rlike(word) & F.substr(body, F.lit(1), F.lit(1)).rlike(word)
        rest = F.substr(t, (i + 1) * seg_chars + 1, F.lit(more))
        tail = F.when(F.right(body, F.lit(1)).rlike(word), F.regexp_extract(rest, "^" + word, 0)).otherwise(F.lit(""))
        begun = F.when(inside, F.regexp_replace(body, "^" + word, "")).otherwise(body)
        return F.when(inside & (F.length(begun) == 0), F.lit("")).otherwise(F.concat(begun, tail))

    segs = F.transform(F.sequence(F.lit(0), nseg - 1), segment)
    staged = df.select(*keep, F.transform(segs, lambda s: T.words(s)).alias("__segtoks"),
                       nseg.alias("segments"))
    def scorer(c):
        return lambda tk: _bucket(lexicon_score(tk, lex, c))

    out = [F.array_max(F.transform("__segtoks", scorer(c))).alias(c) for c in CATEGORIES]
    return staged.select(*keep, "segments", *out)
