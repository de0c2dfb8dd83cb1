import numpy as np
from pyspark.sql import functions as F

from leafmill.operators import batches
from leafmill.sources import pdf, pdf_content, pdf_merge, rasters
from leafmill.sources.pdf import Name
from tests.test_sources import jpeg


def linked(label):
    """A page with a bookmark, a named destination, a link to it and a form field."""
    doc = pdf.from_text(label)
    page, own = doc.pages()[0]
    own["Annots"] = [doc.add({"Subtype": Name("Link"), "Dest": b"here"}), doc.add({"Subtype": Name("Link"), "A": {"S": Name("GoTo"), "D": Name("old")}})]
    pdf.with_pages(doc, [(page, own)])
    page = doc.pages()[0][0]
    mark = doc.add({"Title": pdf.text_string(f"in {label}"), "Dest": b"here"})
    root = doc.catalog()
    root["Outlines"] = doc.add({"First": mark, "Last": mark, "Count": 1})
    root["Names"] = {"Dests": {"Kids": [doc.add({"Names": [b"here", [page, Name("Fit")]]})]}}
    root["Dests"] = {"old": [page, Name("Fit")]}
    root["AcroForm"] = {"Fields": [doc.add({"T": b"name", "FT": Name("Tx")})], "XFA": b"x"}
    return doc


def test_names_are_made_unique_and_links_follow():
    doc = pdf.load(pdf.save(pdf_merge.merge([linked("a"), linked("b"), linked("c")], ["A", None, "C"])))
    assert [r["text"] for r in pdf.page_rows(doc)] == ["a", "b", "c"]
    names, strings = pdf_merge.destinations(doc)
    assert sorted(strings) == [b"here", b"here_2", b"here_3"] and sorted(names) == ["old", "old_2", "old_3"]
    pages = doc.pages()
    for (ref, page), end in zip(pages, ("", "_2", "_3")):
        link, action = (doc.get(a) for a in doc.get(page["Annots"]))
        assert link["Dest"] == b"here" + end.encode() and strings[link["Dest"]][0] == ref
        assert action["A"]["D"] == "old" + end and names[action["A"]["D"]][0] == ref
    form = doc.get(doc.catalog()["AcroForm"])
    assert [pdf.string_text(doc.get(f)["T"]) for f in form["Fields"]] == ["name", "name_2", "name_3"] and "XFA" not in form
    top = [doc.get(i) for i in pdf_merge.outline_items(doc)]
    assert [pdf.string_text(i["Title"]) for i in top] == ["A", "in b", "C"]
    assert doc.get(top[0]["First"])["Dest"] == b"here" and top[1]["Dest"] == b"here_2" and top[0]["Count"] == -1


def test_stamps():
    doc = pdf.merge([pdf.from_text("one"), pdf.rotate(pdf.from_text("two"), 90)])
    red = np.zeros((2, 3, 4), np.uint8)
    red[..., 0] = red[..., 3] = 200
    doc = pdf.load(pdf.save(pdf_content.stamp(doc, red, {1: (10, 20, 30, 40), 2: (10, 20, 30, 40)}, opacity=0.5)))
    found = [list(pdf_content.drawings(doc, p)) for _, p in doc.pages()]
    assert found[0][0][1] == (30.0, 0.0, -0.0, 40.0, 10.0, 20.0) and found[1][0][1][:4] == (0.0, 30.0, -40.0, 0.0)
    image = doc.get(found[0][0][0])
    assert pdf_content.decode_image(doc, image)[0, 0].tolist() == [200, 0, 0]
    assert set(pdf.decoded(doc, doc.get(image.entries["SMask"]))) == {100}


def test_jpegs_turn_without_reencoding():
    plain, tagged = jpeg((0xE0, b"JFIF\0\1\1\1\0\x48\0\x48\0\0")), jpeg((0xE1, rasters.orientation_segment(6)[4:]))
    assert rasters.orientation(rasters.turned_jpeg(plain, 90)) == 6 and rasters.orientation(rasters.turned_jpeg(tagged, 90)) == 3
    assert len(rasters.turned_jpeg(tagged, 270)) == len(tagged) and rasters.orientation(rasters.turned_jpeg(tagged, -90)) == 1
