"""Text rules agree with a direct Python statement of the JavaScript behaviour."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from workboard.functions import text as X

# ECMAScript WhiteSpace + LineTerminator code points (the set trim() removes)
JS_WS = set("\t\n\x0b\x0c\r       　﻿") | {chr(c) for c in range(0x2000, 0x200B)}

alphabet = st.sampled_from(sorted(JS_WS) + list("aZ0_-/() ") + ["\u0085", "​", "é", "Ü"])
strings = st.lists(st.text(alphabet, max_size=12), min_size=1, max_size=60)


def js_trim(s: str) -> str:
    i, j = 0, len(s)
    while i < j and s[i] in JS_WS:
        i += 1
    while j > i and s[j - 1] in JS_WS:
        j -= 1
    return s[i:j]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=strings)
def test_trim_and_role_key(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r.i: (r.t, r.k, r.b) for r in df.select(
        "i", X.ws_trim("v").alias("t"), X.normalize_job_role("v").alias("k"), X.is_blank("v").alias("b")).collect()}
    for i, v in enumerate(values):
        t = js_trim(v)
        assert got[i][0] == t, (v, got[i][0], t)
        assert got[i][1] == X.JOB_ROLE_LOOKUP.get(X._role_key_py(t)), v
        assert got[i][2] == (t == "")
