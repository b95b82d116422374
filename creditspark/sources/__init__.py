"""creditspark.sources"""
