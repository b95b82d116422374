"""creditspark.operators"""
