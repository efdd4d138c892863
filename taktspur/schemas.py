"""Fixed schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_DAY, _TS = T.DateType(), T.TimestampNTZType()

# Columns of the daily feed before the product and operator filter; all text
# but the station number, times are parsed afterwards.
RAW_EVENTS = _schema(
    BETRIEBSTAG=_S, FAHRT_BEZEICHNER=_S, PRODUKT_ID=_S, BETREIBER_ABK=_S, BPUIC=_L,
    LINIEN_ID=_S, LINIEN_TEXT=_S, VERKEHRSMITTEL_TEXT=_S, HALTESTELLEN_NAME=_S, SLOID=_S,
    ANKUNFTSZEIT=_S, AN_PROGNOSE=_S, AN_PROGNOSE_STATUS=_S,
    ABFAHRTSZEIT=_S, AB_PROGNOSE=_S, AB_PROGNOSE_STATUS=_S,
    FAELLT_AUS_TF=_B, DURCHFAHRT_TF=_B,
)

EVENTS = _schema(
    betriebstag=_DAY, fahrt_bezeichner=_S, linien_text=_S, verkehrsmittel_text=_S, bpuic=_L,
    haltestellen_name=_S, sloid=_S, ankunftszeit=_TS, an_prognose=_TS, an_prognose_status=_S,
    abfahrtszeit=_TS, ab_prognose=_TS, ab_prognose_status=_S, delay_arr_sec=_D, delay_dep_sec=_D,
    faellt_aus_tf=_B, durchfahrt_tf=_B,
)

STATIONS = _schema(
    number=_L, sloid=_S, designationofficial=_S, abbreviation=_S, cantonabbreviation=_S,
    cantonname=_S, lat=_D, lon=_D, meansoftransport=_S,
)

WEATHER = _schema(
    station_abbr=_S, reference_timestamp=_TS, tre200h0=_D, rre150h0=_D, fkl010h0=_D,
    ure200h0=_D, sre000h0=_D,
)

# Weather measure -> name in the prepared table.
WEATHER_NAMES = {
    "tre200h0": "temperatur_c",
    "rre150h0": "niederschlag_mm",
    "fkl010h0": "wind_ms",
    "ure200h0": "feuchte_pct",
    "sre000h0": "sonne_min",
}

_FEATURES = _schema(
    hour=_I, weekday_num=_I, weekday=_S, is_weekend=_B, is_rush_hour=_B,
    weather_abbr=_S, delay_ts_hour=_TS, temperatur_c=_D, niederschlag_mm=_D, wind_ms=_D,
    feuchte_pct=_D, sonne_min=_D, delay_class=_S, is_late_3min=_B,
)

PREPARED = T.StructType(EVENTS.fields + _FEATURES.fields)

DAY_REASONS = _schema(
    datum=_DAY, wochentag=_S, pct_late_3min=_D, mean_delay_s=_D, llm_ursache=_S,
    llm_konfidenz=_S, llm_begruendung=_S,
)
