"""Declared schemas of the source tables and literal relations.

No schema is inferred anywhere; readers fail on files that do not fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Published column lists of the clinical source tables.
CLINICAL = {
    "d_labitems": "itemid int, label string, fluid string, category string",
    "d_items": (
        "itemid int, label string, abbreviation string, linksto string, category string, unitname string, "
        "param_type string, lownormalvalue double, highnormalvalue double"
    ),
    "patients": (
        "subject_id int, gender string, anchor_age int, anchor_year int, anchor_year_group string, dod date"
    ),
    "icustays": (
        "subject_id int, hadm_id int, stay_id int, first_careunit string, last_careunit string, "
        "intime timestamp_ntz, outtime timestamp_ntz, los double"
    ),
    "admissions": (
        "subject_id int, hadm_id int, admittime timestamp_ntz, dischtime timestamp_ntz, deathtime timestamp_ntz, "
        "admission_type string, admit_provider_id string, admission_location string, discharge_location string, "
        "insurance string, language string, marital_status string, race string, edregtime timestamp_ntz, "
        "edouttime timestamp_ntz, hospital_expire_flag smallint"
    ),
    "diagnoses_icd": "subject_id int, hadm_id int, seq_num int, icd_code string, icd_version smallint",
    "labevents": (
        "labevent_id bigint, subject_id int, hadm_id int, specimen_id bigint, itemid int, order_provider_id string, "
        "charttime timestamp_ntz, storetime timestamp_ntz, value string, valuenum double, valueuom string, "
        "ref_range_lower double, ref_range_upper double, flag string, priority string, comments string"
    ),
    "chartevents": (
        "subject_id int, hadm_id int, stay_id int, caregiver_id int, charttime timestamp_ntz, storetime timestamp_ntz, "
        "itemid int, value string, valuenum double, valueuom string, warning smallint"
    ),
}

# Telemetry schema, version 2.
RUNS = (
    "schema_version int, run_id string, job_id bigint, node string, git_sha string, timestamp string, "
    "csr_variant string, window_W string, n_stays bigint, n_records bigint, paradigm string, platform string, "
    "gpu string, kernel_variant string, precision string, partitioner string, schedule string, chunk_size int, "
    "row_order string, n_ranks int, n_threads int, smt int, thread_placement string, n_nodes int, stage_mode string, "
    "numa_balancing int, mempolicy string, whitelist_frac double, k_iterations int, timed_region string, "
    "repetition int, warmup int, wall_time_s double, throughput_rec_s double, work_imbalance double, "
    "time_imbalance double, n_records_max_thread bigint, n_records_mean_thread double, bitidentical string, "
    "l3_tcm bigint, l3_tca bigint, tot_cyc bigint, tot_ins bigint, achieved_ghz double, notes string"
)
THREADS = (
    "schema_version int, run_id string, tid int, cpu int, socket int, n_stays bigint, n_records bigint, secs double"
)

LOOKUP = "dense_id int, slot int, vscale float, voffset float, lo float, hi float"
LOOKUP_DEFAULTS = {"slot": -1, "vscale": 1.0, "voffset": 0.0, "lo": -1e30, "hi": 1e30}

VARMAP_SCHEMA = (
    "variable string, itemid int, src string, tier string, pref int, vscale double, voffset double, "
    "raw_lo double, raw_hi double"
)

# Clinical variable map (variable, item, source, tier,
# preference, scale, offset, exclusive plausibility gate in raw units).
CLINICAL_VARMAP = [
    ("heart_rate", 220045, "chart", "core", 0, 1.0, 0.0, 0.0, 300.0),
    ("sbp", 220179, "chart", "core", 0, 1.0, 0.0, 0.0, 400.0),
    ("sbp", 220050, "chart", "core", 0, 1.0, 0.0, 0.0, 400.0),
    ("sbp", 225309, "chart", "core", 0, 1.0, 0.0, 0.0, 400.0),
    ("dbp", 220180, "chart", "core", 0, 1.0, 0.0, 0.0, 300.0),
    ("dbp", 220051, "chart", "core", 0, 1.0, 0.0, 0.0, 300.0),
    ("dbp", 225310, "chart", "core", 0, 1.0, 0.0, 0.0, 300.0),
    ("mbp", 220181, "chart", "core", 0, 1.0, 0.0, 0.0, 300.0),
    ("mbp", 220052, "chart", "core", 0, 1.0, 0.0, 0.0, 300.0),
    ("mbp", 225312, "chart", "core", 0, 1.0, 0.0, 0.0, 300.0),
    ("resp_rate", 220210, "chart", "core", 0, 1.0, 0.0, 0.0, 70.0),
    ("resp_rate", 224690, "chart", "core", 0, 1.0, 0.0, 0.0, 70.0),
    ("spo2", 220277, "chart", "core", 0, 1.0, 0.0, 0.0, 100.001),
    ("temperature", 223762, "chart", "core", 0, 1.0, 0.0, 10.0, 50.0),
    ("temperature", 223761, "chart", "core", 0, 5.0 / 9.0, -160.0 / 9.0, 70.0, 120.0),
    ("gcs_eye", 220739, "chart", "core", 0, 1.0, 0.0, 0.5, 4.5),
    ("gcs_motor", 223901, "chart", "core", 0, 1.0, 0.0, 0.5, 6.5),
    ("gcs_verbal", 223900, "chart", "core", 0, 1.0, 0.0, 0.5, 5.5),
    ("lactate", 50813, "lab", "core", 0, 1.0, 0.0, 0.0, 50.0),
    ("bun", 51006, "lab", "core", 0, 1.0, 0.0, 0.0, 300.0),
    ("creatinine", 50912, "lab", "core", 0, 1.0, 0.0, 0.0, 150.0),
    ("wbc", 51301, "lab", "core", 0, 1.0, 0.0, 0.0, 1000.0),
    ("hemoglobin", 51222, "lab", "core", 0, 1.0, 0.0, 0.0, 30.0),
    ("platelets", 51265, "lab", "core", 0, 1.0, 0.0, 0.0, 10000.0),
    ("sodium", 50983, "lab", "pool", 1, 1.0, 0.0, 0.0, 200.0),
    ("potassium", 50971, "lab", "pool", 2, 1.0, 0.0, 0.0, 30.0),
    ("bicarbonate", 50882, "lab", "pool", 3, 1.0, 0.0, 0.0, 10000.0),
    ("anion_gap", 50868, "lab", "pool", 4, 1.0, 0.0, -100.0, 10000.0),
    ("chloride", 50902, "lab", "pool", 5, 1.0, 0.0, 0.0, 10000.0),
    ("glucose_chart", 225664, "chart", "pool", 6, 1.0, 0.0, 0.0, 2000.0),
    ("glucose_chart", 220621, "chart", "pool", 6, 1.0, 0.0, 0.0, 2000.0),
    ("glucose_chart", 226537, "chart", "pool", 6, 1.0, 0.0, 0.0, 2000.0),
    ("calcium", 50893, "lab", "pool", 7, 1.0, 0.0, 0.0, 10000.0),
    ("magnesium", 50960, "lab", "pool", 8, 1.0, 0.0, 0.0, 20.0),
    ("albumin", 50862, "lab", "pool", 9, 1.0, 0.0, 0.0, 10.0),
    ("alt", 50878, "lab", "pool", 10, 1.0, 0.0, 0.0, 10000.0),
    ("bilirubin_tot", 50885, "lab", "pool", 11, 1.0, 0.0, 0.0, 100.0),
    ("inr", 51237, "lab", "pool", 12, 1.0, 0.0, 0.0, 50.0),
    ("fio2", 223835, "chart", "pool", 13, 1.0, 0.0, 0.0, 100.001),
]


def clinical_varmap(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLINICAL_VARMAP, VARMAP_SCHEMA)
