"""Sources and sinks: image folders, Arrow IPC files, Parquet splits with a manifest, conversion and batches."""
