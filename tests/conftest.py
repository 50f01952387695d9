"""Shared session and a small own base: two feeders that meet at both ends and a lone third one.

    A0 =KA0= A1 - A2 - A3 =KA1= A4 - A5 - A6 /KA2/ A8 ~ B5 - B4 - B3 =KB1= B2 - B1 =KB0= B0
                                      \\ A7 ~ B7 /KB2/ B6 - /            G1 - G2 =KG1= G3

``=`` closed switch, ``/`` open switch, ``~`` the switch stands about a metre from that line's end. KB3 stands open in the yard of
AL1's substation. The layers are tables of text; geometry follows from the node map.
"""

from __future__ import annotations

import struct

import pytest
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from gridlake.session import build_session, clear_scratch
from gridlake.sources.catalog import LayerCatalog, contract_type


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "gridlake-tests", "local[8]", **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
            "spark.default.parallelism": "4", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch")),
        }
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_scratch(session)
    session.stop()


# --- geometry bytes: little-endian point, one-part line, one-ring area -----------------------------


def point(x, y) -> bytes:
    return struct.pack("<BIdd", 1, 1, x, y)


def line(*vertices) -> bytes:
    part = struct.pack("<BII", 1, 2, len(vertices)) + b"".join(struct.pack("<dd", *v) for v in vertices)
    return struct.pack("<BII", 1, 5, 1) + part


def square(west, south, east, north) -> bytes:
    corners = ((west, south), (east, south), (east, north), (west, north), (west, south))
    part = struct.pack("<BIII", 1, 3, 1, 5) + b"".join(struct.pack("<dd", *v) for v in corners)
    return struct.pack("<BII", 1, 6, 1) + part


# --- the base -------------------------------------------------------------------------------------

#: Places in thousandths of a degree east of 40 W and north of 20 S.
PLACES = """
A0 0 0 | A1 0.1 0 | A2 1 0 | A3 2 0 | A4 2.2 0 | A5 3 0 | A6 4 0 | A7 3.1 1 | A8 4.2 0
B0 8 0.5 | B1 7.9 0.5 | B2 7 0.5 | B3 6.8 0.5 | B4 6 0.5 | B5 4.1 0.01 | B6 3.2 1 | B7 3 1.02 | B8 0.1 0.01 | B9 0.1 0.01
G1 20 5 | G2 21 5 | G3 21.2 5
"""
NODE = {name: (-40 + float(x) / 1000, -20 + float(y) / 1000) for name, x, y in (p.split() for row in PLACES.strip().split("\n") for p in row.split("|"))}

TABLES = {
    "CTMT": """
        COD_ID NOME   SUB PAC_INI TEN_NOM UNI_TR_AT CONJ ENE
        AL1    NORTE_01 SA A0     46      TA        7    900000
        BE1    LESTE_02 SB B0     46      TB        7    600000
        GA1    SUL_03   SG G0     67      TG        7    300000""",
    "CONJ": """
        COD_ID NOME
        7      VILA_CLARA""",
    "SUB": """
        COD_ID NOME
        SA     ESTACAO_A
        SB     ESTACAO_B
        SG     ESTACAO_G""",
    "UNTRAT": """
        COD_ID SUB POT_NOM CONJ
        TA     SA  30000   7
        TB     SB  20000   7
        TC     SB  15000   7
        TG     SG  10000   7""",
    "SSDMT": """
        COD_ID CTMT SUB UNI_TR_AT CONJ PAC_1 PAC_2 PN_CON_1 PN_CON_2 TIP_CND COMP
        SA1    AL1  SA  TA        7    A1    A2    P1       P2       W1      95
        SA2    AL1  SA  TA        7    A2    A3    P2       P3       W1      105
        SA3    AL1  SA  TA        7    A4    A5    P3       P4       W1      84
        SA4    AL1  SA  TA        7    A5    A6    P4       P5       W2      105
        SA5    AL1  SA  TA        7    A5    A7    P4       P6       W2      111
        SB1    BE1  SB  TB        7    B1    B2    P11      P12      W1      94
        SB2    BE1  SB  TB        7    B3    B4    P12      P13      W1      84
        SB3    BE1  SB  TB        7    B4    B5    P13      P14      W1      196
        SB4    BE1  SB  TB        7    B4    B6    P13      P15      W1      298
        SG1    GA1  SG  TG        7    G1    G2    P21      P22      W3      105""",
    "UNSEMT": """
        COD_ID CTMT SUB UNI_TR_AT CONJ MUN PAC_1 PAC_2 FAS_CON TIP_UNID P_N_OPE TLCD
        KA0    AL1  SA  TA        7    51  A0    A1    ABC     29       F       1
        KA1    AL1  SA  TA        7    51  A3    A4    ABC     22       F       0
        KA2    AL1  SA  TA        7    51  A6    A8    ABC     32       A       1
        KB0    BE1  SB  TB        7    51  B0    B1    ABC     29       F       1
        KB1    BE1  SB  TB        7    51  B2    B3    ABC     19       F       0
        KB2    BE1  SB  TB        7    51  B6    B7    ABC     19       A       0
        KB3    BE1  SB  TB        7    51  B8    B9    ABC     29       A       1
        KG1    GA1  SG  TG        7    52  G2    G3    ABC     22       F       0""",
    "UNTRMT": """
        COD_ID CTMT SUB UNI_TR_AT CONJ MUN PAC_1 PAC_2 PAC_3 POT_NOM
        T1     AL1  SA  TA        7    51  A5    L1    -     75
        T2     AL1  SA  TA        7    51  A3    L2    -     30
        T3     BE1  SB  TB        7    51  B4    L3    -     112.5
        T4     GA1  SG  TG        7    52  G2    L4    -     150""",
    "UNREMT": """
        COD_ID CTMT SUB UNI_TR_AT CONJ MUN PAC_1 PAC_2
        R1     GA1  SG  TG        7    52  G2    G3""",
    "UNCRMT": """
        COD_ID CTMT SUB UNI_TR_AT CONJ MUN PAC_1 PAC_2
        C1     AL1  SA  TA        7    51  A2    -
        C2     AL1  SA  TA        7    51  A6    -""",
    "SSDBT": """
        COD_ID CTMT SUB UNI_TR_AT CONJ UNI_TR_MT PAC_1 PAC_2 PN_CON_1 PN_CON_2 TIP_CND COMP
        LA     AL1  SA  TA        7    T1        L1    L1a   P31      P32      W2      20
        LB     BE1  SB  TB        7    T3        L3    L3a   P41      P42      W2      20""",
    "UNSEBT": """
        COD_ID CTMT SUB UNI_TR_AT CONJ MUN UNI_TR_MT PAC_1 PAC_2 P_N_OPE TLCD
        KL     AL1  SA  TA        7    51  T1        L1a   L1b   F       0""",
    "RAMLIG": """
        COD_ID CTMT SUB UNI_TR_AT CONJ UNI_TR_MT PAC_1 PAC_2 PN_CON_1 PN_CON_2 TIP_CND COMP
        D1     AL1  SA  TA        7    T1        L1b   U1p   P61      P71      W2      12
        D2     BE1  SB  TB        7    T3        L3a   U5p   P62      P72      W2      12""",
    "UCBT": """
        COD_ID CTMT SUB UNI_TR_AT CONJ MUN UNI_TR_MT PAC RAMAL PN_CON TIP_CC FAS_CON TEN_FORN CAR_INST ENE
        U1     AL1  SA  TA        7    51  T1        L1a D1    P71    RES    AN      11 0.2      100
        U2     AL1  SA  TA        7    51  T1        L1a D1    P71    RES    BN      11 0.3      200
        U3     AL1  SA  TA        7    51  T1        L1b D1    P71    RES    ABN     11 0.6      300
        U4     AL1  SA  TA        7    51  T1        L1b D1    P71    RES    CN      11 0.6      300
        U5     BE1  SB  TB        7    51  T3        L3a D2    P72    RES    AN      11 0.4      150
        U6     BE1  SB  TB        7    51  T3        L3a D2    P72    RES    ABCN    11 1.5      450
        U7     GA1  SG  TG        7    52  T4        L4  -     P73    RES    AN      11 0.2      120
        U8     BE1  SB  TB        7    51  T2        L2  -     P74    RES    AN      11 0.2      80""",
    "UCMT_tab": """
        COD_ID CTMT SUB UNI_TR_AT CONJ MUN PAC PN_CON TIP_CC FAS_CON TEN_FORN CAR_INST ENE
        M1     AL1  SA  TA        7    51  A3  P81    COM    ABC     46 250      50000
        M2     GA1  SG  TG        7    52  G2  P82    COM    ABC     46 150      30000""",
    "UGBT_tab": """
        COD_ID CTMT SUB UNI_TR_AT CONJ MUN UNI_TR_MT PAC PN_CON CEG_GD   FAS_CON DAT_CON    POT_INST ENE
        X1     AL1  SA  TA        7    51  T1        L1a P71    GD.RJ.X1 ABCN    2021-03-04 6        600
        X2     BE1  SB  TB        7    51  T3        L3a P72    GD.RJ.X2 ABCN    2023-05-06 9        900""",
    "UGMT_tab": """
        COD_ID CTMT SUB UNI_TR_AT CONJ MUN PAC PN_CON CEG_GD   FAS_CON DAT_CON    POT_INST ENE
        X3     AL1  SA  TA        7    51  A3  P81    GD.RJ.X3 ABC     2022-01-02 400      40000""",
    "SEGCON": """
        COD_ID CNOM
        W1     100
        W2     200
        W3     300""",
}


def _value(column: str, text: str):
    kind = contract_type(column)
    if text == "-":
        return "" if isinstance(kind, StringType) else None
    if column == "NOME":
        return text.replace("_", " ")
    return text if isinstance(kind, StringType) else float(text) if isinstance(kind, DoubleType) else int(text)


def read_table(text: str) -> list[dict]:
    """Rows of a text table; ``ENE`` stands for twelve equal months."""
    head, *rows = (r.split() for r in text.strip().split("\n"))
    out = []
    for row in rows:
        found = dict(zip(head, row, strict=True))
        energy = found.pop("ENE", None)
        made = {k: _value(k, v) for k, v in found.items()}
        out.append(made | ({f"ENE_{m:02d}": float(energy) for m in range(1, 13)} if energy else {}))
    return out


def build_layers() -> dict[str, list[dict]]:
    layers = {name: read_table(text) for name, text in TABLES.items()}
    for r in layers["SSDMT"]:
        r |= {"FAS_CON": "ABC", "geometry": line(NODE[r["PAC_1"]], NODE[r["PAC_2"]])}
    for name in ("UNSEMT", "UNREMT"):
        for r in layers[name]:
            (x, y), (u, v) = NODE[r["PAC_1"]], NODE[r["PAC_2"]]
            r["geometry"] = point((x + u) / 2, (y + v) / 2)
    for name in ("UNTRMT", "UNCRMT"):
        for r in layers[name]:
            r["geometry"] = point(*NODE[r["PAC_1"]])
    for r, at in zip(layers["SUB"], ("A1", "B1", "G1"), strict=True):
        x, y = NODE[at]
        r["geometry"] = square(x - 3e-4, y - 3e-4, x + 3e-4, y + 3e-4)
    for r in layers["UNTRAT"]:
        r["geometry"] = point(*NODE["A0"])
    feeder = {r["COD_ID"]: NODE[r["PAC_1"]] for r in layers["UNTRMT"]}
    for name in ("SSDBT", "UNSEBT", "UCBT"):
        for i, r in enumerate(layers[name]):
            x, y = feeder[r["UNI_TR_MT"]]
            r["geometry"] = point(x, y - 1e-5 * i) if name != "SSDBT" else line((x, y - 2e-4), (x + 2e-4, y - 2e-4))
    layers["UCBT_tab"] = [{k: v for k, v in r.items() if k != "geometry"} for r in layers["UCBT"]]
    poles = {r[c] for rows in layers.values() for r in rows for c in ("PN_CON", "PN_CON_1", "PN_CON_2") if r.get(c)} | {"P998", "P999"}
    layers["PONNOT"] = [{"COD_ID": p, "CONJ": "7", "MUN": "51", "geometry": point(*NODE["A2"])} for p in sorted(poles)]
    layers["CRVCRG"] = [{"COD_ID": c, "TIP_DIA": d, **{f"POT_{i:02d}": (0.25 if i <= 48 else 0.75) for i in range(1, 97)}} for c in ("RES", "COM") for d in ("DU", "SA", "DO")]
    layers["EQTRMT"] = [{"COD_ID": "Q" + r["COD_ID"], "UNI_TR_MT": r["COD_ID"], "POT_NOM": 1.0} for r in layers["UNTRMT"]]
    layers["EQSE"] = [{"COD_ID": "Q" + r["COD_ID"], "UN_SE": r["COD_ID"]} for r in layers["UNSEMT"]]
    return layers


def to_frames(spark, layers):
    frames = {}
    for name, rows in layers.items():
        columns = list(dict.fromkeys(k for r in rows for k in r))
        schema = StructType([StructField(c, contract_type(c)) for c in columns])
        frames[name] = spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], schema)
    return frames


@pytest.fixture(scope="session")
def base_path(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("base")
    for name, df in to_frames(spark, build_layers()).items():
        df.coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="session")
def catalog(spark, base_path):
    return LayerCatalog(spark, base_path)


@pytest.fixture(scope="session")
def ties(catalog):
    from gridlake.operators.ties import detect_ties
    from gridlake.session import materialise

    return materialise(detect_ties(catalog.read("UNSEMT"), catalog.read("SSDMT"), catalog.read("SUB")), "ties")
