"""BibTeX files give the same entries wherever they are cut into splits."""

import gzip
import random

import pytest

from lectern.sources import readers


def nasty(rng: random.Random, n: int) -> str:
    """Entries whose values hold lines that begin with @, even whole entries, and text between entries."""
    inner = ["plain words", "@home alone", "@article{inner, title = {not mine}}", "{nested {deep}\n@misc{x,\ntitle={also not}}}", "ümläut 汉字", "a = b, c # d"]
    parts = ["% a comment\n", "中间这段不是条目\n", '@string{acl = "Association"}\n', "@comment{skip\n@this}\n", '@preamble{"\\newcommand{\\x}[1]{}"}\n', "  @article{indented, title = {Indented}, year = 1999}\n", "@misc(paren, title = {In (round) brackets})\n", "@broken\n"]
    out = []
    for i in range(n):
        note = "\n".join(rng.choice(inner) for _ in range(rng.randint(0, 60 if rng.random() < 0.1 else 4)))
        out.append(f"@{rng.choice(['article', 'inproceedings'])}{{k{i},\n  title = {{A {{T}}itle {i}}},\n  author = {{Lee, Ann and Ray, Bo}},\n  note = {{{note}}},\n  year = {{{1990 + i % 30}}}\n}}\n")
        if rng.random() < 0.4:
            out.append(rng.choice(parts))
    return "".join(out)


def told(df):
    return sorted((r.key, r.kind, r.title, r.year, tuple(r.authors or ()), tuple(sorted(r["fields"].items()))) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_cut_anywhere(spark, tmp_path, seed):
    rng = random.Random(seed)
    for name in "ab":
        (tmp_path / f"{name}.bib").write_text(nasty(rng, 150))
    (tmp_path / "c.bib").write_text(nasty(rng, 20) + "@article{last,\n title = {Open end},\n note = {no\n@closing")
    with gzip.open(tmp_path / "d.bib.gz", "wt") as f:
        f.write(nasty(rng, 30))
    plain = []
    for name in "abcd":
        text = gzip.open(tmp_path / "d.bib.gz", "rt").read() if name == "d" else (tmp_path / f"{name}.bib").read_text()
        scanner = readers.BibScanner()
        entries = [*scanner.feed(text), *(["".join(scanner.held)] if scanner.held else [])]
        plain += [f for e in entries if (f := readers.bib_fields(e)) and f.get("key") and f.get("title")]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    found = []
    try:
        for size in (700, 1_024, 65_536, 2**30):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            df = readers.read_bibtex(spark, str(tmp_path / "*.bib*"))
            found.append(told(df))
            if size == 1_024:
                readers.BROADCAST_SPLITS, kept = 0, readers.BROADCAST_SPLITS
                found.append(told(readers.read_bibtex(spark, str(tmp_path / "*.bib*"))))
                readers.BROADCAST_SPLITS = kept
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((f["key"], f["title"]) for f in plain) == [(k, t) for k, _, t, *_ in found[0]]
    assert all(f == found[0] for f in found[1:]) and not any("not" in t for _, _, t, *_ in found[0])
    assert {"last", "paren", "indented"} <= {k for k, *_ in found[0]} and sum(k.startswith("k") for k, *_ in found[0]) == 350


def test_states_of_a_split():
    text = "x}} @a{b} }\n@c{d"
    assert readers.bib_ends(text) == {"": ("{", 1), "{1": ("{", 1), "{2": ("{", 1), "{3": ("{", 1), "{": ("", -2), "(": ("", 0)}
    assert readers.bib_ends("@a{b}")[""] == ("", 0) and readers.bib_ends("(({")["("] == ("", 2)
