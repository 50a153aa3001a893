"""Documented cases with known answers."""

import datetime

from pyspark.sql import functions as F

from hostelry.functions import licence, numeric, text
from hostelry.operators import bins
from hostelry.operators.polygons import zone_group


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


L = F.lit


def cases():
    NULL = F.lit(None).cast("string")
    return [
        (text.embedded_code(L("Hotel chic&basic Born Boutique - HB-004452")), "HB-004452"),
        (text.embedded_code(L("Apartaments HUTB001234 centre")), "HUTB-001234"),
        (text.embedded_code(L("no code")), None),
        (text.clean_code(L("HUTB- 077183")), "HUTB-077183"),
        (text.clean_code(L("   ")), None),
        (text.first_number(L("2-4")), "2"),
        (text.unit(L("01")), "1"),
        (text.unit(L("Bx")), "BX"),
        (text.unit(L("00")), "00"),
        (text.street(L(""), L("C Princesa")), "CARRER PRINCESA"),
        (text.street(NULL, L("Ronda de Sant Antoni")), "RONDA SANT ANTONI"),
        (text.street(L("CARRER"), L("Carrer de Llançà")), "CARRER LLANCA"),
        (text.street(L(""), L("")), ""),
        (text.address_key(L("Barcelona"), L("C"), L("Balmes"), L("12-14")), "BARCELONA|CARRER BALMES|12"),
        (text.address_key(L("Barcelona"), L("C"), L("Balmes"), NULL), None),
        (text.name_similarity(L("Hotel Toledano"), L("Hostal Toledano Barcelona")), 1.0),
        (text.name_similarity(L("Hotel"), L("Toledano")), 0.0),
        (text.postcode(L("8001.0")), "08001"),
        (text.brand(L("Mc Donald's")), "MCDONALDS"),
        (text.brand(L("Starbucks Coffee")), "STARBUCKS"),
        (text.company(L("Hotels Units S.L. (Hotel X).")), "HOTELS UNITS S.L"),
        (text.company(L("No aplica")), None),
        (text.identifier(L("{ABCDEF01-2345-6789-ABCD-EF0123456789}")), "abcdef01-2345-6789-abcd-ef0123456789"),
        (text.without_sentinel(L(" sn ")), None),
        (text.display_name(L("SANT MARTI")), "Sant Martí"),
        (text.address_line(L("Carrer"), L("Balmes"), L("129-131"), L("Barcelona")), "Carrer Balmes 129, Barcelona"),
        (text.without_bracket_tail(L("Licencia hotelera (HB)")), "Licencia hotelera"),
        (text.first_label(text.both_names(L("Hotel Barceló Raval"), NULL), text.CHAINS, "none"), "Barcelo"),
        (licence.canonical(L("hutb-5204")), "HUTB-005204"),
        (licence.canonical(L("HUTB 12345678")), "HUTB-12345678"),
        (licence.canonical(L("Exempt")), None),
        (licence.is_filler(L("123456")), True),
        (licence.is_filler(L("0")), True),
        (licence.is_filler(L("111111")), True),
        (licence.is_filler(L("246789")), False),
        (licence.classify(L("ESFCTU HUTB-1"), L("Exempt")), "exempt"),
        (licence.classify(L("Exempt - tourist apartment"), NULL), "none"),
        (licence.classify(L("ESHFNT0001"), NULL), "seasonal"),
        (licence.regional_section(L("Barcelona - Regional registration number<br />HB-1<br />Spain"), "Barcelona"), "HB-1"),
        (numeric.money(L("$1,409.00")), 1409.0),
        (numeric.money(L("")), None),
        (numeric.price_band(L(39.99)), "€"),
        (numeric.price_band(L(40.0)), "€€"),
        (numeric.price_band(L(120.0)), "€€€€"),
        (numeric.price_band(F.lit(None).cast("double")), None),
        (numeric.right_closed(L(6), [0, 6, 27, 31], ["short", "middle", "long"]), "short"),
        (numeric.right_closed(L(7), [0, 6, 27, 31], ["short", "middle", "long"]), "middle"),
        (numeric.right_closed(L(32), [0, 6, 27, 31], ["short", "middle", "long"]), None),
        (numeric.capacity_units(L(0), L(4)), 2.0),
        (numeric.capacity_units(F.lit(None).cast("int"), L(1)), 1.0),
        (numeric.capacity_units(F.lit(None).cast("int"), L(5)), 2.0),
        (numeric.occupied_nights(L(400)), 0),
        (numeric.to_number(L("NaN")), None),
        (numeric.locale_number(L("12,5")), 12.5),
        (numeric.month_label_date(L("Jan 2013")), datetime.date(2013, 1, 1)),
        (numeric.month_label_date(L("Foo 2013")), None),
        (numeric.utc_month(L("2026-07-01T00:00:00.000+02:00")), "2026-06"),
        (numeric.case_year(L("01-2018-0509")), 2018),
        (bins.change_class(L(1.0), L(-10.0)), "loses a little"),
        (bins.change_class(L(0.0), L(99.0)), "none"),
        (zone_group(L("ze3a")), "ze3"),
    ]


def test_cases(spark):
    wrong = []
    for i, (column, expected) in enumerate(cases()):
        got = value(spark, column)
        if got != expected:
            wrong.append((i, got, expected))
    assert not wrong
