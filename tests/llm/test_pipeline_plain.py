"""The pipeline against a plain version in Python; of the operators it only takes the classifier's scores."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import corpus_pipeline
from marlstone.llm import quality_model, quality_rules
from test_join_cells import classes_of, sets_of
from test_rules_mix_urls import base


def passes_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars, symbols, dup, repeat = base(text)
    if n < 20 or 100 * repeat > 30 * n:
        return False
    stops = sum(w.lower() in quality_rules.STOP_WORDS for w in words)
    ratio = {"mean_word_chars": chars / n, "symbols_per_word": symbols / n, "bangs_per_word": text.count("!") / n, "stop_word_ratio": stops / n, "dup_line_ratio": dup / (text.count("\n") + 1)}
    ratio |= {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "n_stop_words": stops}
    return all((r.low is None or ratio[r.metric] >= r.low) and (r.high is None or ratio[r.metric] <= r.high) for r in quality_rules.RULES)


def times_taken(docs):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in docs}
    sources = sorted({s for _, _, s in docs})
    total = {s: sum(size[i] for i, _, x in docs if x == s) for s in sources}
    weight, target, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}, {}, set(sources)
    while left:
        share = (sum(total.values()) - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * share >= 3 * total[s]}
        target |= {s: 3 * total[s] for s in over} if over else {s: weight[s] * share for s in left}
        left = left - over if over else set()
    out = Counter()
    for s in sources:
        before = 0
        h = {i: hashlib.md5(str(i).encode()).hexdigest() for i, _, x in docs if x == s}
        for i in sorted(h, key=lambda i: (int(h[i][:6], 16) % 4096, h[i])):
            out[i] = sum(before + size[i] / 2 + k * total[s] <= target[s] for k in range(3 if size[i] else 1))
            before += size[i]
    return out


def test_pipeline_is_the_plain_version(spark, data):
    import public_tokenizers
    from tokenizers import Tokenizer

    table = spark.read.parquet(f"{data}/documents.parquet")
    model = quality_model.train(table, spark.read.parquet(f"{data}/labels.parquet"))
    good = {r["doc_id"] for r in quality_model.score(table, model).collect() if r["score"] >= 0.3}
    docs = [(r["doc_id"], r["text"], r["source"]) for r in table.collect() if r["doc_id"] in good and passes_rules(r["text"] or "")]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))) for i, t, _ in docs]
    group = classes_of(sets_of(words, 5), 8)
    docs = [d for d in docs if group[d[0]] == d[0]]
    taken, tokenizer, want = times_taken(docs), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for i, text, _ in docs:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, piece, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += taken[i]
    rows = corpus_pipeline.run(spark, data).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == +want
    for held in (sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == s) for s in {r["sequence_id"] for r in rows}):
        assert [a for a, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 4096
