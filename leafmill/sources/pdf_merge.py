"""Merging PDF files with what points into them: bookmarks, named destinations, form fields."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from leafmill.sources import pdf
from leafmill.sources.pdf import Document, Name, Ref, Stream


def unique_name(name, taken, first: int):
    """``name``, or it with the first free number from ``first`` on."""
    made, n = name, first
    while made in taken:
        made = name + (f"_{n}".encode() if isinstance(name, bytes) else f"_{n}")
        n += 1
    return made


def outline_items(doc: Document) -> list[Ref]:
    """Top-level bookmarks in order."""
    item, out = (doc.get(doc.catalog().get("Outlines")) or {}).get("First"), []
    while isinstance(item, Ref) and item not in out and isinstance(doc.get(item), dict):
        out.append(item)
        item = doc.get(item).get("Next")
    return out


def link_siblings(doc: Document, items: list[Ref], parent: Ref) -> None:
    for i, ref in enumerate(items):
        item = doc.get(ref)
        item["Parent"] = parent
        for key, at in (("Prev", i - 1), ("Next", i + 1)):
            item.pop(key, None)
            if 0 <= at < len(items):
                item[key] = items[at]


def build_outline(doc: Document, sources: list[tuple[str | None, Ref | None, list[Ref]]]) -> None:
    """One outline: a bookmark over the items of each titled source, the items of others in their place."""
    root, top = doc.add({"Type": Name("Outlines")}), []
    for title, page, items in sources:
        if title is None or page is None:
            top += items
            continue
        entry = {"Title": pdf.text_string(title), "Dest": [page, Name("Fit")]}
        mark = doc.add(entry)
        if items:
            entry |= {"First": items[0], "Last": items[-1], "Count": -len(items)}
            link_siblings(doc, items, mark)
        top.append(mark)
    doc.catalog().pop("Outlines", None)
    if top:
        link_siblings(doc, top, root)
        doc.get(root).update({"First": top[0], "Last": top[-1], "Count": len(top)})
        doc.catalog()["Outlines"] = root


def _tree(doc: Document, node, depth: int = 0) -> Iterator[tuple[bytes, object]]:
    node = doc.get(node)
    if not isinstance(node, dict) or depth > 32:
        return
    pairs = doc.get(node.get("Names")) or []
    yield from ((k, v) for k, v in zip(pairs[::2], pairs[1::2]) if isinstance(k, bytes))
    for kid in doc.get(node.get("Kids")) or []:
        yield from _tree(doc, kid, depth + 1)


def destinations(doc: Document) -> tuple[dict[str, object], dict[bytes, object]]:
    """Named destinations: those of the dictionary (by name) and of the name tree (by string)."""
    root = doc.catalog()
    names = doc.get(root.get("Names"))
    return dict(doc.get(root.get("Dests")) or {}), dict(_tree(doc, names.get("Dests")) if isinstance(names, dict) else ())


def _renamed_links(value, rename: Callable):
    """The value with destinations in links and go-to actions renamed."""
    if isinstance(value, list):
        return [_renamed_links(v, rename) for v in value]
    if isinstance(value, Stream):
        return Stream(_renamed_links(value.entries, rename), value.raw)
    if not isinstance(value, dict):
        return value
    jump = value.get("S") == "GoTo"
    return {k: rename(v) if (k == "Dest" or (k == "D" and jump)) and isinstance(v, Name | bytes) else _renamed_links(v, rename) for k, v in value.items()}


def merge(docs: list[Document], titles: list[str | None] | None = None) -> Document:
    """All pages in order with their bookmarks, destinations and fields; clashing names get numbers.

    Catalog and properties are the first document's; page labels are dropped.
    """
    titles = titles or [None] * len(docs)
    named: dict[str, object] = {}
    strings: dict[bytes, object] = {}
    fields: list = []
    taken: set[str] = set()
    form: dict = {}
    sources, pages, shift = [], [], 0
    whole = Document(version=max(d.version for d in docs))
    for number, (doc, title) in enumerate(zip(docs, titles)):

        def moved(value, shift=shift):
            if isinstance(value, Ref):
                return Ref(value.number + shift)
            if isinstance(value, list):
                return [moved(v) for v in value]
            if isinstance(value, dict):
                return {k: moved(v) for k, v in value.items()}
            return Stream(moved(value.entries), value.raw) if isinstance(value, Stream) else value

        own_names, own_strings = destinations(doc)
        new: dict = {}
        for found, every in ((own_names, named), (own_strings, strings)):
            for name, target in found.items():
                made = unique_name(name, every, number + 1)
                new[type(name), name] = made
                every[made] = moved(target)

        def rename(value, new=new):
            made = new.get((bytes if isinstance(value, bytes) else str, bytes(value) if isinstance(value, bytes) else str(value)), value)
            return made if isinstance(value, bytes) else Name(made)

        own_pages, items = doc.pages(), outline_items(doc)
        root = doc.catalog()
        own_form = doc.get(root.get("AcroForm"))
        if isinstance(own_form, dict):
            form = form or {k: moved(v) for k, v in own_form.items() if k not in ("Fields", "XFA")}
            for ref in doc.get(own_form.get("Fields")) or []:
                entry = doc.get(ref)
                if isinstance(entry, dict) and "T" in entry:
                    label = unique_name(pdf.string_text(doc.get(entry["T"])), taken, number + 1)
                    taken.add(label)
                    entry["T"] = pdf.text_string(label)
                fields.append(moved(ref))
        whole.objects |= {n + shift: _renamed_links(moved(v), rename) for n, v in doc.objects.items()}
        own_pages = [(moved(ref), _renamed_links(moved({k: v for k, v in page.items() if k != "Parent"}), rename)) for ref, page in own_pages]
        pages += own_pages
        sources.append((title, own_pages[0][0] if own_pages else None, [moved(i) for i in items]))
        if not number:
            whole.trailer = {k: moved(v) for k, v in doc.trailer.items() if k in ("Root", "Info")}
        shift = max(whole.objects, default=0)
    root = whole.catalog()
    for key in ("PageLabels", "Names", "Dests", "AcroForm"):
        root.pop(key, None)
    pdf.with_pages(whole, pages)
    build_outline(whole, sources)
    if named:
        root["Dests"] = {str(k): v for k, v in named.items()}
    if strings:
        root["Names"] = {"Dests": {"Names": [x for k in sorted(strings) for x in (k, strings[k])]}}
    if fields:
        root["AcroForm"] = form | {"Fields": fields}
    return whole
