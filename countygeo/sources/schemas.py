"""Schemas of the stored tables (D1-D18); reads never infer and fail on bad rows."""

from __future__ import annotations

PANOS = "panoid string, lng double, lat double, adcode string, kind string, adcode_status string"
POOL = "panoid string, adcode string, lng double, lat double, part string, vehicle string, date string, city string"
SAMPLES = POOL + ", obsolete int, width int, height int"
POINTS = "adcode string, seq int, lng double, lat double"
STATE = ("panoid string, adcode string, part string, state string, error string, tile_z int, block_x int, block_y int, "
         "bytes bigint, width int, height int, date string, obsolete int, updated double")
SPLIT_FILE = ("seed bigint, params map<string,double>, grouping string, holdout_adcodes array<string>, "
              "test_counties_present array<string>, counts map<string,bigint>, assignments map<string,string>")
POSITIONS_FILE = "customCoordinates array<struct<panoId:string,lng:double,lat:double,heading:double>>"
COVERAGE_FILE = "version int, source string, source_sha256 string, coverage map<string,map<string,array<string>>>"
NAMES_FILE = "names map<string,string>"
BOUNDARY_FILE = ("features array<struct<properties:struct<adcode:string,level:string>,"
                 "geometry:struct<type:string,coordinates:string>>>")
RESULTS = ("panoid string, truth string, truth_lng double, truth_lat double, date string, "
           "top array<struct<adcode:string,prob:double>>, lon double, lat double, km double, landed string, "
           "hit1 boolean, hit3 boolean, hit5 boolean, landed_hit boolean, prov_hit boolean, near50 boolean")
METRICS = ("top1 double, top5 double, top10 double, macro_recall double, majority_baseline double, n bigint, "
           "top5_nearby_150km double, top1_median_km double, top1_mean_km double")
RUN_LOG = ("epoch int, train_loss double, train_acc double, minutes double, data_seconds double, compute_seconds double, "
           f"samples_per_sec double, gpu_peak_gb double, val_same struct<{METRICS.replace(' double', ':double').replace(' bigint', ':bigint')}>, "
           f"val_national struct<{METRICS.replace(' double', ':double').replace(' bigint', ':bigint')}>, "
           f"test_county struct<{METRICS.replace(' double', ':double').replace(' bigint', ':bigint')}>")
MEMBERS = "key string, shard string, data_offset bigint, size bigint, meta string, content binary"
COVERAGE = "vehicle string, year string, adcode string"
