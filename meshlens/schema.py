"""Shapes of the tables that operators take and give."""

NODES = "ord long, id string, type string, label string, file string, line int"
EDGES = "ord long, id string, source string, target string, type string, confidence string"
FLAGS = "owner_id string, owner_kind string, ord long, code string, severity string, category string, message string, evidence string, suggestion string"
ENDPOINTS = "ord long, id string, method string, raw_path string, file string, line int, handler string, framework string, has_auth boolean, response_fields array<string>, request_fields array<string>, request_required array<string>"
CALLS = "ord long, id string, method string, url string, confidence string, file string, line int, has_error_handling boolean, has_timeout boolean, expected_fields array<string>, sent_fields array<string>, sent_complete boolean"
OBSERVATIONS = "ord long, ts_ms long, method string, route string, path string, dur_ms double, status int, trace_id string"
CLIENTS = "ord long, trace_id string, method string, path string"
COVERAGE = "file string, line int, state string"
HISTORY = "ts double, iso string, graph_hash string, total_risk double, nodes long, wires long, endpoints long, flags_total long, flags_critical long, by_code map<string,long>"
