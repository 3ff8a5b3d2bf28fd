"""Reports, the feature build and the study that ties them together."""
