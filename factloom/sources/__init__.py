"""Sources and sinks: repositories, snapshots, study files."""
