import math

import pytest

from tideline.llm import langid as L
from tideline.llm import prose as P

DOC = r"""\documentclass{article}
\newcommand{\x}{Ein Satz hier. Noch ein Satz.}

\begin{document}
\title{The title is English}
% a comment. In English. Of course.
\section{Heading}

Une deuxi\`eme enqu\^ete r\'eduit l'erreur ($a$ is \emph{x}). Le r\'eseau suit la \textbf{courbe}~\cite{k}.

\begin{comment}
English text inside. Not typeset.

Still inside. Not typeset.
\end{comment}

\iffalse
More English. Not typeset.
\fi

Gro{\ss}e K\"uhlanlage. Fa\c{c}ade na\"{\i}ve, ru{\'\i}do 5\,\%.

\end{document}
After the end. Not typeset."""


def test_prose_of_each_piece():
    first, t = P.prose(DOC)
    got = t.split(P.GAP)
    assert first == 2 and len(P.pieces(DOC)) == 8
    words = [" ".join(L._WORD.findall(x)) for x in got]
    assert words[0] == "" and words[1] == "Une deuxième enquête réduit l erreur is x Le réseau suit la courbe"
    assert words[2:5] == ["", "", ""] and words[5] == "Große Kühlanlage Façade naïve ruído"


@pytest.mark.parametrize("text", ["", " \n\t\n ", "$$", r"\begin{equation} a", r"\iffalse x", "{}{}{}", "%", "\\", "\\end", "a\r\n\r\nb", "\x1d"])
def test_odd_texts_do_no_harm(text):
    P.prose(text)


def test_pieces_are_numbered_by_blank_lines():
    assert P.pieces("\n \na\n\t\n\n b\r\n\r\nc\n\n") == ["a", " b", "c"]


@pytest.fixture(scope="module")
def model():
    say = [("en", "the lattice limits most of the scatter"), ("en", "a slow drift hides the shape of the curve"), ("de", "das Gitter begrenzt die Streuung"), ("de", "eine langsame Drift verdeckt die Form der Kurve"), ("fr", "le réseau limite la dispersion"), ("fr", "une dérive lente cache la forme de la courbe"), ("ru", "решётка ограничивает разброс")]
    return L.Unigrams(["▁", "▁the", "▁d", "▁die", "▁le", "▁la", "e", "i", "a", "n", "s", "t", "r", "sch", "ch", "▁a", "er", "en"] + list("abcdefghijklmnopqrstuvwxyzäöüßéèàêабвгдеёжзийклмнопрстуфхцчшщъыьэюя"), say)


def test_the_forward_pass_sums_all_segmentations(model):
    def brute(w):
        if not w:
            return [1.0] * len(L.LANGUAGES)
        out = [0.0] * len(L.LANGUAGES)
        for k in range(1, len(w) + 1):
            p = w[:k]
            if p in model.vocabulary or k == 1:
                q = model.table.get(p, model.floor) if p in model.vocabulary else model.floor * 1e-3
                out = [o + a * b for o, a, b in zip(out, q, brute(w[k:]), strict=True)]
        return out

    for w in ("the", "die", "scher", "xyz", "дв"):
        assert all(math.isclose(a, math.log(b), rel_tol=1e-9) for a, b in zip(model.score(w), brute("▁" + w), strict=True))


def test_labels_and_passages(spark, model, monkeypatch):
    monkeypatch.setattr(L, "fit", lambda *a, **k: model)
    en, de = "The lattice limits the scatter. A drift hides the curve.", "Das Gitter begrenzt die Streuung. Die Drift verdeckt die Kurve."
    rows = [(1, f"{en}\n\n{en}\n\n{de}", "English", "q"), (2, f"{de}", "en-GB", "q"), (3, None, "en", "q"), (4, "", None, "q"), (5, "$x$", "de", "q"), (6, f"{de}\n\n{de}\n\n The lattice limits most of the scatter.", " DEU ", "q"), (7, de, None, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, segment string")
    got = {(r.doc_id, r.segment, r.lang) for r in L.found(docs, None).collect()}
    assert got == {(1, 3, "de"), (2, 0, "de"), (7, 0, "de")}
    all_ = {(r.doc_id, r.segment): r for r in L.label_documents(docs, None).collect()}
    assert set(all_) == {(1, 0), (1, 3), (2, 0), (6, 0), (7, 0)} and all(0 < r.confidence <= 1 for r in all_.values())
    assert L.found(docs.limit(0), None).count() == 0


def test_spellings_of_labels(spark):
    df = spark.createDataFrame([("en_US",), (" Fr ",), ("ger",), ("Spanish",), ("??",), ("",), (None,), ("xx",), ("pt-BR",)], "lang string")
    assert [r[0] for r in df.select(L.named(df.lang)).collect()] == ["en", "fr", "de", "es", None, None, None, None, "pt"]
