"""The signature rules: each one's own examples, suppression, scores, and texts of many hits."""

import re
import time
from re import _parser as parser

from gridflux.llm import license_rules, licenses


def example(rx: str, long: bool) -> str:
    """A text that rx matches: optional parts and later choices only in the long one."""

    def walk(parts) -> str:
        out = ""
        for kind, arg in parts:
            if kind is parser.LITERAL:
                out += chr(arg)
            elif kind is parser.IN:
                at = arg[-1 if long else 0]
                out += chr(at[1]) if at[0] is parser.LITERAL else chr(at[1][1 if long else 0]) if at[0] is parser.RANGE else "7"
            elif kind is parser.SUBPATTERN:
                out += walk(arg[-1])
            elif kind is parser.BRANCH:
                out += walk(arg[1][-1 if long else 0])
            elif kind is parser.MAX_REPEAT:
                out += walk(arg[2]) * (arg[1] if long else arg[0])
            else:
                raise NotImplementedError(kind)
        return out

    return walk(parser.parse(rx))


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r for r in sorted(licenses.scan(df).collect(), key=lambda r: r.doc_id)]


def test_every_rule_finds_its_own_examples_and_not_a_cut_one(spark):
    rules = license_rules.rules()
    assert len(license_rules.written_rules()) >= 200
    cases = [(r, example(r[2], long)) for r in rules for long in (False, True)]
    for (label, key, rx, _, _), text in cases:
        assert re.fullmatch(rx, text) and len(key) > 1 and f" {key}" in f" {text}", (label, key, rx, text)
    for (label, _, rx, level, _), text, got in zip((c[0] for c in cases), (c[1] for c in cases), found(spark, [f"Xx {t}, xx" for _, t in cases])):
        inside = any(d.start <= 1 and d.end >= 1 + len(text.split()) for d in got.detections)
        assert inside and got.score > 0, (label, rx, text)
    for (_, _, rx, _, _), text, got in zip((c[0] for c in cases), (c[1] for c in cases), found(spark, [f"xx{t}xx" for _, t in cases])):
        assert not any(d.start == 0 and d.end == len(text.split()) for d in got.detections), text  # joined to other letters


def test_contained_detections_of_lower_or_equal_level_are_suppressed(spark):
    got = found(spark, ["GNU General Public License version 3 or any later version", "BSD license, MIT License", "nothing here"])
    assert [(d.label, d.start, d.end) for d in got[0].detections] == [("gpl-3-or-later", 0, 10)]
    assert got[0].labels == "gpl,gpl-3-or-later" and got[0].n_base == 1 and got[0].score == 1.0
    assert [d.label for d in got[1].detections] == ["bsd", "mit"] and got[1].score == 0.8
    assert got[2].labels == "" and got[2].score == 0.0


def test_words_that_a_keyword_must_not_miss(spark):
    got = found(spark, ["released under license apache 2.0", "PostgreSQL Licence"])
    assert "apache-2.0" in got[0].labels and "postgresql" in got[1].labels


def test_a_long_text_of_hits_takes_seconds(spark):
    began = time.time()
    got = found(spark, ["cc by foo " * 40_000])
    assert got[0].n_base == 40_000 and len(got[0].detections) == 40_000
    assert time.time() - began < 60
