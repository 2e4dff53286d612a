import json

from logprism.sources import targets

GOOD = {"document_id": "1", "target_id": " web ", "status": "Active", "hostname": "h", "user": "u",
        "paths": [" /var/log ", " "], "sample_line_count": 7}


def check(spark, *documents):
    rows = [(d if isinstance(d, str) else json.dumps(d),) for d in documents]
    raw = targets.read_targets(spark.createDataFrame(rows, "document string"))
    return [(r, list(r.reasons)) for r in targets.check_targets(raw).collect()]


def test_good_target(spark):
    (row, reasons), = check(spark, GOOD)
    assert reasons == []
    assert (row.target_id, row.host, row.port, row.username, row.log_paths) == ("web", "h", 22, "u", ["/var/log"])
    assert row.auth_kind == "none" and row.sample_line_count == 7


def test_nested_connection(spark):
    nested = {"target_id": "a", "status": "active", "host": "  ", "log_paths": [],
              "connection": {"ip": "1.2.3.4", "ssh_port": 2200, "username": "n", "folders": ["/x"]}}
    (row, reasons), = check(spark, nested)
    assert (row.host, row.port, row.username) == ("1.2.3.4", 2200, "n")
    assert reasons == [targets.NO_PATHS]  # a list that is there but empty hides the nested one


def test_all_reasons_in_order(spark):
    bad = {"target_id": "a$", "status": "off", "credentials": {"auth_method": " Token "}}
    (_, reasons), (_, empty) = check(spark, bad, {"target_id": " "})
    assert reasons == [
        "target status is `off` instead of `active`", targets.NO_HOST, targets.NO_USER, targets.NO_PATHS,
        "unsupported auth_method `token`", "target_id `a$` is not a valid MongoDB collection name",
    ]
    assert empty[:2] == [targets.NO_TARGET, "target status is `` instead of `active`"]


def test_unreadable(spark):
    documents = ["{not json", {**GOOD, "host": "twice"}, {**GOOD, "port": 70000}, {**GOOD, "max_files": -1},
                 {**GOOD, "log_paths": "no list"}]
    assert [reasons for _, reasons in check(spark, *documents)] == [[targets.UNREADABLE]] * 5


def test_auth(spark):
    cases = [
        ({"password": "p"}, "password", None),
        ({"password": "  "}, None, targets.NO_PASSWORD),
        ({"credentials": {"password": "p"}, "private_key": "k"}, "password", None),
        ({"private_key_file": "/k"}, "private_key_path", None),
        ({"private_key": "k", "private_key_path": "/k"}, "private_key_inline", None),
        ({"credentials": {"auth_method": "KEY", "private_key_file": "/k"}}, "private_key_path", None),
        ({"credentials": {"auth_method": "key"}}, None, targets.NO_KEY),
        ({"private_key": " "}, None, targets.NO_KEY),
    ]
    for (row, reasons), (_, kind, error) in zip(check(spark, *[{**GOOD, **extra} for extra, _, _ in cases]), cases):
        assert row.auth_kind == kind
        assert reasons == ([error] if error else [])


def test_valid_and_rejects(spark):
    raw = targets.read_targets(spark.createDataFrame([(json.dumps(GOOD),), ("{}",)], "document string"))
    valid, rejects = targets.validate_targets(raw)
    assert [r.target_id for r in valid.collect()] == ["web"]
    assert len(rejects.first().reasons) == 5
