"""Readers of sensor files and vector lines on small files."""

import datetime

from gaugeloom.sources import sensors, vectors


def test_sensor_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "s.1.csv").write_text("#head;x\n2024-01-01 00:00:00;1,5\n2024-01-01 01:00:00;\nshort\n2024-01-01 02:00:00;abc\nnever;2,5;more\n")
    (tmp_path / "s2.csv").write_text("2024-01-02 00:00:00;-3\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "other.txt").write_text("2024-01-02 00:00:00;9\n")
    path = f"file://{tmp_path}"
    day = datetime.datetime
    got = sorted(map(tuple, sensors.read_sensor_csv(spark, path).collect()), key=repr)
    assert got == sorted([("s.1", day(2024, 1, 1), 1.5), ("s.1", day(2024, 1, 1, 1), None), ("s.1", day(2024, 1, 1, 2), None), ("s.1", None, 2.5), ("s2", day(2024, 1, 2), -3.0)], key=repr)
    report = {r.sensor: tuple(r)[1:] for r in sensors.sensor_file_report(spark, path).collect()}
    assert report == {"s.1": (6, 1, 1, 1, 1, 1), "s2": (1, 0, 0, 0, 0, 0)}
    assert {(r.stem, r.bytes > 0) for r in sensors.discover(spark, path, "csv").collect()} == {("s.1", True), ("s2", True)}  # Spark passes over empty files
    assert sensors.discover(spark, path).count() == 3


FEATURES = [
    '{"type": "Feature", "properties": {"id": "7", "name": "Rhine", "width": "12,5"}, "geometry": {"type": "LineString", "coordinates": [[1.0, 2.0], [3, 4, 9.0]]}}',
    '{"type": "Feature", "properties": {"id": 8, "name": null}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[5, 5], [6, 6], [7, 7]]]}}',
    '{"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}}',
    '{"type": "Feature", "properties": {}, "geometry": null}',
]


def test_line_vertices(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "c").mkdir()
    (tmp_path / "l" / "x.json").write_text("\n".join([*FEATURES, '{"type": "Fea']) + "\n")
    (tmp_path / "c" / "y.json").write_text('{"type": "FeatureCollection", "features": [\n' + ",\n".join(FEATURES) + "]}\n")
    (tmp_path / "c" / "broken.json").write_text('{"type": "FeatureCollection", "features": [')
    for folder, whole in (("l", True), ("c", False)):
        path = f"file://{tmp_path}/{folder}"
        rows = vectors.read_line_vertices(spark, path, "id", lines=whole).collect()
        by_line = {}
        for r in sorted(rows, key=lambda r: r.seq):
            by_line.setdefault(r.line_id, []).append((r.lon, r.lat))
        assert by_line[7] == [(1.0, 2.0), (3.0, 4.0)] and by_line[8] == [(0.0, 0.0), (1.0, 1.0)]
        assert len(by_line) == 3 and [(5.0, 5.0), (6.0, 6.0), (7.0, 7.0)] in by_line.values()
        assert {(r.name, r.width) for r in rows if r.line_id == 7} == {("Rhine", 12.5)} and {(r.name, r.width) for r in rows if r.line_id == 8} == {(None, None)}
        assert len({r.line_id for r in vectors.read_line_vertices(spark, path, lines=whole).collect()}) == 3
        report = sorted((r.file.rsplit("/", 1)[1], r.features, r.lines, r.others, r.bad) for r in vectors.line_file_report(spark, path, whole).collect())
        assert report == ([("x.json", 5, 2, 1, 2)] if whole else [("broken.json", 1, 0, 0, 1), ("y.json", 4, 2, 1, 1)])
