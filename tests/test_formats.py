import datetime
import zipfile

import numpy as np
import pandas as pd
import pytest

from ostinato.catalog import catalog
from ostinato.cli import main
from ostinato.functions.scalar import clean_header, snap_to_grid, strip, well_name, zfill
from ostinato.sources import envision, harmony
from ostinato.sources.sonar import format_sonar, pivot_times
from ostinato.sources.tables import read_platemap
from ostinato.sources.xlsx import read_xlsx

HEADER = "Plate,Barcode,Well,Flashes/Time,MeasTime,CalcResultI,Signal,,CalcResultI,Signal,MeasTime,,"


def report(path, stamp, values):
    lines = ["Plate information", "Plate,Barcode,Measurement date,Extra", f'1,=""B1"",{stamp},x', "", "Results", HEADER]
    lines += [f'1,=""B1"",{well},100,0.5,{v},{s},,,,,,' for well, v, s in values]
    lines += ["", "Basic assay information", "9,after,the,end"]
    path.write_text("\r\n".join(lines) + "\r\n")


@pytest.fixture
def reports(tmp_path):
    folder = tmp_path / "reads"
    folder.mkdir()
    report(folder / "b.csv", "03/01/2026 10:29:00 AM", [("A01", "12", "NA"), ("A02", "13.5", "7")])
    report(folder / "a.csv", "03/01/2026 09:00:00 AM", [("A01", "1", "2"), ("A02", "3", "4")])
    report(folder / "c.csv", "3/1/2026 01:02:00 PM", [("A01", "5", "6")])
    return folder


def test_header_names_number_repeats():
    assert envision.header_names("a,b,a,,,a") == ["a", "b", "a_duplicated_0", "", "_duplicated_0", "a_duplicated_1"]


def test_envision(spark, reports, tmp_path):
    data, times = envision.parse_reports(spark, str(reports), 0.5)
    assert data.columns == ["Well", "CalcResultI", "Signal", "Timepoint"]
    got = {tuple(r) for r in data.collect()}
    assert got == {
        ("A01", "1", "2", 0.0),
        ("A02", "3", "4", 0.0),
        ("A01", "12", None, 1.5),
        ("A02", "13.5", "7", 1.5),
        ("A01", "5", "6", 4.0),
    }
    gaps = envision.format_envision(spark, str(reports), str(tmp_path / "all.tsv"), 0.5).orderBy("after_hour").collect()
    assert [(g.after_file, g.before_file, g.n_missing, g.missing_hours) for g in gaps] == [
        ("a", "b", 2, [0.5, 1.0]),
        ("b", "c", 4, [2.0, 2.5, 3.0, 3.5]),
    ]
    written = spark.read.csv(str(tmp_path / "all.tsv"), sep="\t", header=True)
    assert written.count() == 5 and written.columns == data.columns


def test_report_lines(spark):
    header = "Plate,Barcode,Well"
    lines = {"a": ["x", header, "1,p,A1", "2,p,A2", "", "3,p,A3"], "b": ["9,p,A0", header, "4,q,B1"], "c": [header, "no,p,A1", "5,p,A2"]}
    rows = [(f, k, line) for f, part in lines.items() for k, line in enumerate(part)]
    got = envision.data_lines(spark.createDataFrame(rows[::-1], "file string, number int, line string")).collect()
    assert sorted((r.file, r.cells[0]) for r in got) == [("a", "1"), ("a", "2"), ("b", "4")]
    assert {r.header for r in got} == {header}
    with pytest.raises(Exception, match="no data header in d"):
        envision.data_lines(spark.createDataFrame([("d", 0, "1,2")], "file string, number int, line string")).collect()


@pytest.mark.parametrize("query", ["report_rows", "report_times"])
def test_reports_are_not_gathered(spark, tmp_path, query):
    rows = [(k, 7 if k % 3 else k, datetime.datetime(2024, 1, 1), "view", 1.5) for k in range(30)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double")
    events.write.parquet(str(tmp_path / "events.parquet"))
    found = catalog()[query](spark, str(tmp_path))
    assert found.count() == (30 if query == "report_rows" else 11)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_envision_refuses(spark, tmp_path):
    report(tmp_path / "x.csv", "no date", [("A01", "1", "2")])
    with pytest.raises(Exception, match="no measurement date"):
        envision.parse_reports(spark, str(tmp_path))[1].collect()
    other = tmp_path / "other"
    other.mkdir()
    (other / "y.csv").write_text("i\nMeasurement date\n03/01/2026 10:29:00 AM\nPlate,Barcode,Well\n1,2,A01\n")
    with pytest.raises(ValueError, match="lack"):
        envision.parse_reports(spark, str(other))


@pytest.fixture
def plate(tmp_path):
    folder = tmp_path / "raw" / "plate one"
    folder.mkdir(parents=True)
    head = "\t".join(["Row", "Column", "Timepoint", "Field", "Position X [µm]", "Área [µm²]_", "Sign\tNote"]) + "\t\n"
    rows = ["1\t2\t1\t3\t0.1\t10\tNaN\tok\t\t", "27\t12\t2\t3\t0.2\t20\t-1", "2\t112\t3\t3\t0.3\tNULL\t5\t\t"]
    (folder / "Objects_Population - Nuclei.txt").write_text("".join(f"preamble {i}\n" for i in range(9)) + head + "\n".join(rows) + "\n")
    (folder / "PlateResults.txt").write_text("skip")
    (folder / "PlateResult.txt").write_text("skip")
    (folder / ".done").write_text("skip")
    (folder.parent / "indexfile.txt").write_text("skip")
    return folder.parent


def test_harmony(spark, plate, tmp_path):
    files = harmony.list_files(spark, str(plate))
    assert [(f.dataset, f.object_type) for f in files] == [("plate one", "Nuclei")]
    out = harmony.process_harmony(spark, str(plate), str(tmp_path / "out"), "Timepoint", 2.0, intermediate_dir=str(tmp_path / "mid"))
    target = out["plate one"]["Nuclei"]
    assert target.endswith("plate one._.Nuclei.analysis_ready.tsv")
    got = spark.read.csv(target, sep="\t", header=True)
    assert got.columns == ["WellName", "Timepoint", "Area [um2]", "Sign", "Note"]
    rows = {tuple(r) for r in got.collect()}
    assert rows == {("A02", "0.0", "10", None, "ok"), ("[12", "2.0", "20", "-1", None), ("B112", "4.0", None, "5", None)}
    middle = spark.read.csv(str(tmp_path / "mid" / "plate one._.Nuclei.formatted.txt"), sep="\t", header=True)
    assert middle.count() == 3 and middle.columns[:2] == ["Row", "Column"]
    with pytest.raises(ValueError):
        harmony.read_objects(spark, files[0].path, 50)
    other = tmp_path / "out" / "other.tsv"
    other.write_text("x")
    for replace in (False, True):
        harmony.process_harmony(spark, str(plate), str(tmp_path / "out"), "Timepoint", 2.0, replace_dir=replace)
        assert other.exists() != replace and spark.read.csv(target, sep="\t", header=True).count() == 3
    with pytest.raises(ValueError):
        harmony.process_harmony(spark, str(plate), str(plate), "Timepoint", 2.0, replace_dir=True)


def test_clean_header():
    assert clean_header(" _Área [µm²]_ ") == "Area [um2]_".strip("_")
    assert clean_header("μm³") == "um3"


def test_scalars(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        well_name(F.lit(2), F.lit(3)).alias("well"),
        zfill(F.lit("123"), 2).alias("long"),
        strip(F.lit("\t x \n")).alias("strip"),
        *[snap_to_grid(F.lit(v), 1.0).alias(f"g{i}") for i, v in enumerate([0.5, 1.5, 2.5])],
    ).first()
    assert tuple(row) == ("B03", "123", "x", 0.0, 2.0, 2.0)


def write_xlsx(path, rows):
    def cell(c, r, v):
        at = f"{chr(65 + c)}{r + 1}"
        if v is None:
            return ""
        return f'<c r="{at}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{at}" t="s"><v>{strings.index(v)}</v></c>'

    strings = sorted({v for row in rows for v in row if isinstance(v, str)})
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    body = "".join(f'<row r="{r + 1}">' + "".join(cell(c, r, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows))
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="s" sheetId="1" r:id="rId7"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId7" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}">' + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>')


MAP = [["Well", "Line", "period"], ["A01", " x\t", 24], ["A02", "x", None], ["B01", "y", 30.5], ["A01", "z", 1]]


def test_xlsx(spark, tmp_path):
    write_xlsx(tmp_path / "map.xlsx", MAP)
    got = read_platemap(spark, str(tmp_path / "map.xlsx"))
    assert got.columns == MAP[0]
    assert [tuple(r) for r in got.collect()] == [("A01", " x\t", "24"), ("A02", "x", None), ("B01", "y", "30.5"), ("A01", "z", "1")]
    assert read_xlsx(spark, str(tmp_path / "map.xlsx")).count() == 4


def test_sonar(spark, tmp_path):
    rng = np.random.default_rng(0)
    cells = pd.DataFrame([(w, t, "m", rng.normal()) for w in ("A01", "B02") for t in (0, 1, 10) for _ in range(4)], columns=["w", "t", "meta", "x"])
    cells.to_csv(tmp_path / "cells.tsv", sep="\t", index=False)
    format_sonar(spark, str(tmp_path / "cells.tsv"), str(tmp_path / "wide.tsv"), "median", "w", "t", ["meta"])
    wide = spark.read.csv(str(tmp_path / "wide.tsv"), sep="\t", header=True)
    assert wide.columns == ["w", "feature", "meta", "0.0", "1.0", "10.0"] and wide.count() == 2
    want = cells[(cells["w"] == "A01") & (cells["t"] == 10)]["x"].median()
    assert float(wide.where("w = 'A01'").first()["10.0"]) == pytest.approx(want)
    wells = spark.read.csv(str(tmp_path / "wide_median_wells"), sep="\t", header=True)
    assert {r.w for r in wells.select("w").distinct().collect()} == {"A01", "B02"}


def test_command_line(spark, reports, plate, tmp_path):
    main(["formatter", "envision", str(reports), str(tmp_path / "e.tsv"), "-s", "0.5"])
    assert spark.read.csv(str(tmp_path / "e.tsv"), sep="\t", header=True).count() == 5
    main(["formatter", "harmony", str(plate), str(tmp_path / "h"), "-t", "Timepoint", "-s", "1"])
    rng = np.random.default_rng(1)
    cells = pd.DataFrame([("A01", t, rng.normal()) for t in range(20) for _ in range(3)], columns=["Well", "t", "x"])
    cells.to_csv(tmp_path / "cells.tsv", sep="\t", index=False)
    main(["preprocess", str(tmp_path / "cells.tsv"), str(tmp_path / "s.parquet"), "-w", "Well", "-t", "t", "-f"])
    assert spark.read.parquet(str(tmp_path / "s.parquet")).count() == 20
    main(["preprocess", str(tmp_path / "cells.tsv"), str(tmp_path / "d.parquet"), "-w", "Well", "-t", "t", "--window", "3"])
    assert spark.read.parquet(str(tmp_path / "d.parquet")).count() == 16
    write_xlsx(tmp_path / "map.xlsx", MAP)
    t = np.arange(96)
    reads = pd.concat([pd.DataFrame({"Well": w, "t": t, "lum": np.cos(2 * np.pi * (t + 0.5) / p)}) for w, p in (("A01", 24), ("A02", 32), ("Z99", 24))])
    reads.to_csv(tmp_path / "reads.tsv", sep="\t", index=False)
    main(["dct", str(tmp_path / "reads.tsv"), str(tmp_path / "map.xlsx"), str(tmp_path / "dct"), "-w", "Well", "-t", "t", "-e", "lum", "-g", "Line"])
    wells = {r.Well: (r.group_label, float(r.detected_period)) for r in spark.read.csv(str(tmp_path / "dct" / "per_well_period_results.csv"), header=True).collect()}
    assert wells == {"A01": ("x", 24.0), "A02": ("x", 32.0)}
    group = spark.read.csv(str(tmp_path / "dct" / "period_results.csv"), header=True).first()
    assert (group.Line, float(group.mean_period), float(group.std_period), group.n_replicates) == ("x", 28.0, 4.0, "2")


def test_preamble_goes_by_place(spark, tmp_path):
    """Data rows that look like a preamble line or the header stay."""
    lines = ["pre"] * 2 + ["Row\tColumn\tTimepoint"] + ["1\t2\t3", "pre", "Row\tColumn\tTimepoint", "4\t5\t6"]
    path = tmp_path / "objects.txt"
    path.write_text("\n".join(lines) + "\n")
    rows = harmony.read_objects(spark, str(path), 2).collect()
    assert [tuple(r) for r in rows] == [("1", "2", "3"), ("pre", None, None), ("Row", "Column", "Timepoint"), ("4", "5", "6")]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20")
        assert sorted(map(str, harmony.read_objects(spark, str(path), 2).collect())) == sorted(map(str, rows))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_second_value_is_refused(spark):
    stats = spark.createDataFrame([("A", 1, 2.0), ("A", 1, 3.0)], "well string, t int, mean double")
    with pytest.raises(Exception, match="two rows"):
        pivot_times(stats, ["well"], "t", "mean").collect()
