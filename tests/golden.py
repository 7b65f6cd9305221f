"""Two small inputs with known results: a synthetic export (A) and a real one (B)."""

FIELDS = "SYM CLASS COHORT CELL PAIR ERET CRET DRET EHIT CHIT EMFE CMFE DMFE EMAE CMAE DMAE".split()
NA = " NA" * 11

# Fixed values of input A, one record a line in the order of FIELDS.
A = f"""
DOW EQUITY_INDEX T42-H20 B_BAND_T01-05 8 0.850 0.220 0.630 62.500 50.000 1.200 0.900 0.300 -0.400 -0.550 0.150
DOW EQUITY_INDEX T42-H20 B_DIV_T06-10 6 0.500 0.100 0.400 66.700 50.000 0.900 0.700 0.200 -0.300 -0.350 0.050
NAS100 EQUITY_INDEX T42-H20 B_BAND_T01-05 12 1.100 0.300 0.800 58.300 41.700 1.500 1.000 0.500 -0.500 -0.600 0.100
NAS100 EQUITY_INDEX T42-H20 S_DIV_T11-15 4 -0.200 0.150 -0.350 25.000 50.000 0.400 0.600 -0.200 -0.700 -0.450 -0.250
US500 EQUITY_INDEX T42-H20 B_BAND_T01-05 10 0.850 0.200 0.500 60.000 50.000 1.100 0.850 0.250 -0.350 -0.500 0.150
USOIL ENERGY T42-H20 S_BAND_T16-20 7 -0.450 0.100 -0.550 28.600 57.100 0.300 0.650 -0.350 -0.900 -0.400 -0.500
BTCUSD CRYPTO T42-H20 B_DIV_T01-05 15 1.800 0.400 1.400 66.700 46.700 2.500 1.200 1.300 -0.800 -0.950 0.150
EURUSD FX T42-H20 B_BAND_T06-10 0{NA}
XAUUSD METAL T42-H20 S_BAND_T01-05 5 -0.300 0.150 -0.450 40.000 60.000 0.500 0.700 -0.200 -0.600 -0.400 -0.200
XAUUSD METAL T42-H20 S_BAND_T01-05 9 -0.280 0.140 -0.420 44.400 55.600 0.550 0.680 -0.130 -0.580 -0.420 -0.160
DOW EQUITY_INDEX T42-H20 B_BAND_T01-05 8 0.900 0.220 0.680 62.500 50.000 1.250 0.900 0.350 -0.410 -0.550 0.140
NAS100 EQUITY_INDEX T42-H20 B_BAND_XX 3 0.100 0.050 0.050 55.0 50.0 0.200 0.150 0.050 -0.100 -0.120 0.020
""".strip().split("\n")

_BTC = """
BTCUSD CRYPTO T42-H20 S_BAND_T06-10 1 -2.6683 1.8042 -4.4725 .0 100.0 1.4656 2.7096 -1.2441 -2.9828 -2.7758 -0.207
BTCUSD CRYPTO T42-H20 S_BAND_T11-15 2 -1.1024 -0.8466 -0.2557 50.0 50.0 1.5559 3.0849 -1.5291 -2.5612 -1.6698 -0.8914
""".strip().split("\n")

# Fixed values of input B.
B = [
    "XAUUSD METAL T42-H20 S_DIV_T16-20 1 0.3813 -0.0852 0.4665 100.0 .0 1.4021 1.9651 -0.563 -1.0382 -0.7956 -0.2426",
    *_BTC * 5,
    "US500 EQUITY_INDEX T42-H20 B_DIV_T01-05 1 -3.3737 -1.2116 -2.1622 .0 .0 0.0923 0.4749 -0.3826 -3.7602 -1.6629 -2.0972",
    "US500 EQUITY_INDEX T42-H20 S_BAND_T06-10 1 -0.8677 -0.5616 -0.3062 .0 .0 0.2005 0.5749 -0.3744 -1.2511 -0.8922 -0.3589",
    "NAS100 EQUITY_INDEX T42-H20 B_BAND_T06-10 1 2.1046 0.2258 1.8788 100.0 100.0 2.4668 0.5253 1.9415 -0.3683 -1.1521 0.7838",
    "NAS100 EQUITY_INDEX T42-H20 B_BAND_T11-15 1 -1.8679 0.7269 -2.5948 .0 100.0 0.1165 0.9233 -0.8068 -4.1317 -0.1307 -4.0009",
    "USOIL ENERGY T42-H20 B_BAND_T16-20 1 1.5583 -0.5021 2.0604 100.0 .0 2.0554 1.1476 0.9078 -7.7438 -1.8075 -5.936",
    "DJI EQUITY_INDEX T42-H20 B_DIV_T01-05 2 -1.6931 -3.0419 1.3487 .0 .0 1.1142 0.1821 0.932 -3.3371 -5.0018 1.6648",
    "DJI EQUITY_INDEX T42-H20 S_DIV_T06-10 1 1.801 1.3428 0.4583 100.0 100.0 1.9932 1.8622 0.131 -0.4444 -0.5444 0.0999",
]

# Fixed results: group -> pairs, markets, DRET, delta hit, classification.
RESULTS_A = {
    "T42-H20": (71, 6, 0.484648, 5.621127, "CROSS_MARKET_POS"), "B_BAND": (30, 3, 0.668, 13.306667, "EARLY_CONSISTENT_POS"), "B_DIV": (21, 2, 1.114286, 19.057143, "EARLY_CONSISTENT_POS"),
    "S_BAND": (16, 2, -0.476875, -18.76875, "EARLY_CONSISTENT_NEG"), "S_DIV": (4, 1, -0.35, -25.0, "INSUFFICIENT"), "BAND": (46, 5, 0.269783, 2.15, "CROSS_MARKET_POS"),
    "DIV": (25, 3, 0.88, 12.008, "EARLY_CONSISTENT_POS"), "BUY": (51, 4, 0.851765, 15.67451, "EARLY_CONSISTENT_POS"), "SELL": (20, 3, -0.4515, -20.015, "EARLY_CONSISTENT_NEG"),
    "EQUITY_INDEX": (40, 3, 0.526, 9.985, "EARLY_CONSISTENT_POS"),
}
RESULTS_B = {
    "T42-H20": (12, 6, -0.207142, 0.0, "EARLY_MIXED"), "B_BAND": (3, 2, 0.448133, 0.0, "INSUFFICIENT"), "B_DIV": (3, 2, 0.1784, 0.0, "INSUFFICIENT"), "S_BAND": (4, 2, -1.322525, -25.0, "INSUFFICIENT"),
    "S_DIV": (2, 2, 0.4624, 50.0, "INSUFFICIENT"), "BAND": (7, 4, -0.563671, -14.285714, "EARLY_CONSISTENT_NEG"), "DIV": (5, 3, 0.292, 20.0, "EARLY_CONSISTENT_POS"),
    "BUY": (6, 4, 0.313267, 0.0, "EARLY_MIXED"), "SELL": (6, 4, -0.72755, 0.0, "EARLY_MIXED"),
}


def record(line: str, between: str = "|") -> str:
    return "T44C" + "".join(f"{between}{k}={v}" for k, v in zip(FIELDS, line.split(), strict=True))


def text_a() -> str:
    """A field on each line, other log lines between records."""
    return "# strategy initialised\n\n" + "\n\n[log] redraw complete\n\n".join(record(x, "\n|") for x in A) + "\n\n[log] session closed\n"


def text_b() -> str:
    """A record on each line after a time stamp, market headings between."""
    return "XAUUSD\n" + "\n\nEURUSD\nNo log\n".join(f"[2026-08-21T19:00:00.000-00:00]: {record(x)}" for x in B)
