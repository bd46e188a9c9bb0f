"""Sources and sinks: test tables, derived fixtures, headerless CSV inputs, curve sinks."""
