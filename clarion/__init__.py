"""clarion: classification-data analytics on Spark DataFrames.

Data quality and cleaning, exact stratified splits, scaling and correlation
pruning, class weights and synthetic oversampling, clustering and cluster
scores, MLlib training and ensembles, grouped evaluation, batch scoring with
risk tiers, attributions, anomaly thresholds and raster-grid texture metrics --
every operator takes and returns DataFrames.
"""

__version__ = "0.1.0"
