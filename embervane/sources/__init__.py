"""Sources and sinks: dataset binding, artifact storage, reports."""
