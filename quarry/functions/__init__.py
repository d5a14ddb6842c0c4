"""quarry: functions."""
