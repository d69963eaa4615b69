"""Articles of an export: fields, modes, what is left out."""

import pytest

from corpuslab.sources.press import header, press_articles

PAGE = """<html><head><title>x</title></head><body><article><div class="rdp__DocPublicationName"><span class="DocPublicationName">La Croix<br>, no. 43018</span></div>
<div class="titreArticle"><span class="DocHeader">France, mercredi 11 septembre 2024 134 mots, p. 11</span><p class="sm-margin-TopNews titreArticleVisu rdp__articletitle">Le <em>titre</em></p>
<p class="other">beside</p></div><p class="sm-margin-TopNews rdp__subtitle">Un <i>chapeau</i></p><p>Premier paragraphe &amp; suite <a href="u">lien</a></p><div>Politique</div><p>À lire (lien : https://a.b/c)</p>
<p class="sm-margin-bottomNews">note</p><aside>pub</aside><div class="apd-wrapper">doc</div></article><article><p>Seul.</p></article></body></html>"""


@pytest.mark.parametrize(
    "options, text",
    [
        ({}, "Le titre beside Un chapeau Premier paragraphe & suite Politique À lire ."),
        ({"stop_terms": ("Politique",)}, "Le titre Un chapeau Premier paragraphe & suite À lire ."),
        ({"stop_terms": ("Politiq",), "patterns": (r"Premier \w+",)}, "Le titre Un chapeau & suite Politique À lire ."),
        ({"mode": "titre"}, "Letitre."),
        ({"mode": "chapeau"}, "Un chapeau."),
        ({"mode": "titre_chapeau"}, "Letitre Un chapeau."),
    ],
)
def test_modes(spark, options, text):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>none</p>")], "page_id long, html string")
    rows = press_articles(pages, **options).orderBy("page_id", "article").collect()
    assert [(r.page_id, r.article) for r in rows] == [(1, 0), (1, 1)]
    assert rows[0].text == text
    assert (rows[0].journal, str(rows[0].date), rows[0].title, rows[0].subtitle) == ("La Croix, no. 43018", "2024-09-11", "Letitre", "Un chapeau")
    if not options.get("mode"):
        assert (rows[1].journal, rows[1].date, rows[1].text) == ("", None, "Seul.")


def test_header_and_first_piece_of_the_name(spark):
    pages = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    rows = press_articles(pages, whole_name=False)
    got = rows.select("journal", header(rows, extra="var_x").alias("h")).collect()
    assert [(r.journal, r.h) for r in got] == [("La Croix", "**** *source_La_Croix *date_2024-09-11 *am_2024-09 *annee_2024 *var_x"), ("", "**** *var_x")]
