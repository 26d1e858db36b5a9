"""graphwatch: spectral anomaly detection on communication graphs, built on Spark.

Records (who talked to whom) become an ``edges`` DataFrame; edges are cut
into count-based or event-time windows; each window's weighted graph is
summarised by the low end of its normalized-Laplacian spectrum; a baseline
learned from earlier windows and three spectral signals decide which
windows are anomalous. Everything is a DataFrame transformation, so the
same code runs on a laptop and on a cluster.
"""

__version__ = "0.1.0"

# Most used entry points (import lazily to keep `import graphwatch` light):
#   graphwatch.session.get_session
#   graphwatch.sources.registry.load_edges / register_source
#   graphwatch.operators.analyze.analyze / analyze_spectra / calibrate
#   graphwatch.jobs.run_batch / run_calibrate / run_export / diagnose
#   graphwatch.streaming.live.run_stream / run_event_time_stream
