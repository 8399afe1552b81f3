"""Files written and read again."""

import hashlib
import json

import pytest

from recordlink.operators import catalogue, changes, exports
from recordlink.sources import files


def test_pages_sets_truth(spark, tmp_path):
    one = {
        "id": 1, "name": "Élan", "desc": "text", "atk": 5, "misc_info": [{"tcg_date": "2002-03-08", "ocg_date": "", "konami_id": 7, "has_effect": 1}, {"konami_id": 8}], "banlist_info": {"ban_tcg": "Limited"},
        "card_sets": [{"set_name": "S", "set_code": " lob-001", "set_rarity": "Rare", "set_price": " "}, {"set_name": "S", "set_code": "LOB-001", "set_rarity": "Rare", "set_price": "1.25"}, {"set_name": "T", "set_code": "JUMP", "set_price": "2.5"}, {"set_code": " "}],
        "card_images": [{"id": 11, "image_url": "u"}, {"id": 12, "image_url": "v", "image_url_small": "w"}],
    }
    (tmp_path / "page.json").write_text(json.dumps({"data": [one, {"id": 2, "name": "Token"}], "meta": {}}))
    pages = files.card_pages(spark, str(tmp_path / "page.json"))
    cards = {r.card_id: r for r in files.cards_of(pages).collect()}
    assert cards[1].normalised == "elan" and str(cards[1].tcg_date) == "2002-03-08" and cards[1].ocg_date is None and cards[1].konami_id == 7 and cards[1].has_effect and cards[1].ban_tcg == "Limited" and cards[2].konami_id is None
    sets = spark.createDataFrame([("LOB",)], "set_code string")
    got = catalogue.print_rows(files.prints_of(pages), sets).orderBy("set_code_full").collect()
    assert [(r.set_code_full, r.set_prefix, r.number, r.rarity, r.price, r.parsed) for r in got] == [("JUMP", None, None, None, 2.5, False), ("LOB-001", "LOB", "001", "Rare", None, True)]
    assert [(r.image_id, r.is_primary) for r in files.images_of(pages).orderBy("position").collect()] == [(11, True), (12, False)]
    (tmp_path / "truth.json").write_text(json.dumps([{"file": "a", "name": "N"}, {"file": "b", "cells": [{"name": "X"}, {"card_back": True}]}]))
    got = files.ground_truth(spark, str(tmp_path / "truth.json")).orderBy("file", "cell").collect()
    assert [(r.file, r.cell, r.card_back) for r in got] == [("a", 0, False), ("b", 0, False), ("b", 1, True)]


def test_translations_sets_and_enrichment(spark, tmp_path):
    (tmp_path / "language=pt").mkdir()
    (tmp_path / "language=pt" / "p.json").write_text(json.dumps({"data": [{"id": 1, "name": "Dragão", "desc": "d", "name_en": "Dragon"}]}))
    r = files.translated_pages(spark, str(tmp_path)).collect()[0]
    assert (r.card_id, r.language, r.normalised, r.name_en) == (1, "PT", "dragao", "Dragon")
    (tmp_path / "sets.json").write_text(json.dumps([{"set_name": "A", "set_code": " lob", "tcg_date": ""}, {"set_name": "B", "set_code": "SDK", "tcg_date": "2002-03-08"}]))
    assert [(r.set_code, str(r.tcg_date)) for r in files.card_sets(spark, str(tmp_path / "sets.json")).orderBy("set_code").collect()] == [("LOB", "None"), ("SDK", "2002-03-08")]
    (tmp_path / "e.json").write_text(json.dumps([{"password": 5, "name": {"fr": "x", "de": None, "it": "y"}, "is_translation_unofficial": {"name": {"fr": True}}, "sets": {"fr": [{"set_number": "A-1", "set_name": "A", "rarities": None}]}}, {"password": 6}]))
    e = files.enrichment(spark, str(tmp_path / "e.json"))
    assert sorted((r.card_id, r.language, r.unofficial) for r in files.enriched_names(e).collect()) == [(5, "fr", True), (5, "it", False)]
    assert [(r.set_code, list(r.rarities)) for r in files.enriched_prints(e).collect()] == [("A-1", [])]
    state = spark.createDataFrame([("cards", "1", 5), ("sets", "1", 0)], "name string, version string, rows long")
    want = spark.createDataFrame([("cards", "1"), ("sets", "1"), ("new", "1")], "name string, version string")
    assert sorted(map(tuple, files.newer(state, want).collect())) == [("cards", "unchanged"), ("new", "load_empty"), ("sets", "load_empty")]


def test_images_and_readings(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    a, b = b"\xff\xd8\xff\xe0 one", b"\x89PNG\r\n\x1a\n two"
    for name, content in (("b.JPG", a), ("a.png", b), ("c.jpeg", b"no image"), ("d.txt", a), ("sub/e.png", b)):
        (tmp_path / name).write_bytes(content)
    got = files.image_files(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.kind, r.file_hash) for r in got] == [("a.png", "png", hashlib.sha256(b).hexdigest()), ("b.JPG", "jpeg", hashlib.sha256(a).hexdigest()), ("c.jpeg", None, hashlib.sha256(b"no image").hexdigest())]
    assert files.image_files(spark, str(tmp_path), recursive=True).count() == 4 and files.image_files(spark, str(tmp_path), most=1).count() == 1
    (tmp_path / "r.json").write_text(json.dumps({"a.png": {"name": "N", "legible": True}, "b.JPG": {"set_code": "X-1"}}))
    assert sorted((r.file, r.name, r.legible) for r in files.made_readings(spark, str(tmp_path / "r.json")).collect()) == [("a.png", "N", True), ("b.JPG", None, None)]
    raw = spark.createDataFrame([(1, json.dumps({"name": [{"text": "a", "confidence": 0.5, "x": 1.0}, {"text": "b"}]})), (2, "no json"), (3, None)], "image_id long, ocr_raw string")
    assert [(r.image_id, r.region, r.position, r.text) for r in files.raw_lines(raw).orderBy("position").collect()] == [(1, "name", 0, "a"), (1, "name", 1, "b")]


def test_backup_round_trip(spark, tmp_path):
    row = ("i", 1, 'Say "hi", you', None, None, None, None, None, 2, "Near Mint", None, "EN", None, None, None)
    df = spark.createDataFrame([row], files.BACKUP)
    exports.write_csv(df.coalesce(1), str(tmp_path / "out"))
    back = files.backup_csv(spark, str(tmp_path / "out")).collect()
    assert len(back) == 1 and back[0].card_name == 'Say "hi", you' and back[0].quantity == 2 and back[0].source == "import" and back[0].notes is None
    exports.write_csv(df.select("card_id").coalesce(1), str(tmp_path / "other"), newline="\r\n", bom=True)
    with pytest.raises(ValueError):
        files.backup_csv(spark, str(tmp_path / "other"))


def test_exports_are_in_order(spark):
    rows = [(1, None, "S", None, "Near Mint", "EN", 1, "b"), (2, None, None, None, "Damaged", "PT", 2, "=A"), (3, None, None, None, "New", "EN", 1, "A")]
    shown = spark.createDataFrame(rows, "card_id long, print_id string, pending_set string, pending_rarity string, condition string, language string, quantity long, name string")
    shown = shown.selectExpr("*", "pending_set as show_set", "pending_rarity as show_rarity", "cast(null as string) as set_prefix", "false as has_print")
    assert [r.card_name for r in exports.profile("csv", "pocket")(shown).collect()] == ["'=A", "A", "b"]
    assert [r.condition for r in exports.profile("csv", "pocket")(shown).collect()] == ["DMG", "New", "NM"]
    assert [r[0] for r in exports.profile("csv")(shown).collect()] == ["'=A", "A", "b"] and [r.line for r in exports.profile("text", "deck")(shown).collect()] == ["=A", "=A", "A", "b"]
    assert [(r.format, r.name, len(r.columns)) for r in exports.profiles(shown).collect() if r.is_default] == [("csv", "partner", 7), ("text", "list", 1)]
    with pytest.raises(ValueError):
        exports.profile("xml")


def test_headers(spark):
    h = spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, "c", None)], "deck_id long, name string, cover_card long")
    c = spark.createDataFrame([(1, "rename", "z", 1), (1, "cover", "5", 2), (2, "cover", "99", 1), (3, "delete", None, 1), (4, "create", "n", 1)], "deck_id long, op string, value string, seq long")
    got = changes.deck_headers(h, c, spark.createDataFrame([(5,)], "card_id long")).orderBy("deck_id").collect()
    assert [tuple(r) for r in got] == [(1, "z", 5), (2, "b", 5), (4, "n", None)]
